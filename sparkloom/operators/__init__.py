"""Operations, expressions, criteria, ordering, paging and search."""

"""Nothing here yet: the operators are for tables that are rebuilt as a whole; see the README."""

"""Column functions: everything here maps columns to a column, inside codegen."""

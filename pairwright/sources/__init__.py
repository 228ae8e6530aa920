"""Tables to check: delimited files, standard input and DataFrames, as text cells with row numbers and ids."""

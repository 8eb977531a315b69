"""Row-wise post work on streaming DataFrames."""

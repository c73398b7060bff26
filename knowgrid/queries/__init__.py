"""Named queries over a data directory, and the SQL they are held against."""

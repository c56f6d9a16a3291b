"""Where graphs come from: packages on disk, rows in memory, cached scans."""

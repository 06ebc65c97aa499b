"""Writers: delimited files, label files with their data sheet, snapshots, archives of rows, table upserts."""

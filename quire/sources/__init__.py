from quire.sources.files import (FILE_POSITION, NULL_TOKEN, read_csv, read_lines, read_raw_header,
                                 read_variables, tagged_scan, with_file_position)
from quire.sources.records import read_csv_records, read_records
from quire.sources.profile import bytes_on_disk, dataset_profile, rows_per_file

__all__ = ["FILE_POSITION", "with_file_position", "NULL_TOKEN", "read_csv", "read_csv_records", "read_records", "read_lines", "read_raw_header", "read_variables", "tagged_scan",
           "bytes_on_disk", "dataset_profile", "rows_per_file"]

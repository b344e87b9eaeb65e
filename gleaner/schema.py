"""Row types, as DDL."""

RESULT = """path STRING, size BIGINT, type STRING,
image_exif STRUCT<Width:INT,Height:INT,HasExif:BOOLEAN,Exif:STRUCT<date_taken:STRING,camera_model:STRING,lat:DOUBLE,lon:DOUBLE>,IsThumb:BOOLEAN,IsAsset:BOOLEAN,Reason:STRING>,
error STRING, target_path STRING,
additional_info STRUCT<original_name:STRING,time:TIMESTAMP,source:STRING,valid:BOOLEAN,additional_info:MAP<STRING,STRING>>,
quick_hash STRING, full_hash STRING, valid BOOLEAN, validation_error STRING, valid_details MAP<STRING,STRING>"""
JOURNAL = "schema_version INT, timestamp TIMESTAMP, action STRING, source STRING, destination STRING, size BIGINT, sha256 STRING, status STRING, error STRING"
OPERATION = "source STRING, destination STRING, size BIGINT, hash STRING, type STRING, category STRING, status STRING, resumed BOOLEAN, error STRING, start_time TIMESTAMP, end_time TIMESTAMP"
VALIDATION = "path STRING, valid BOOLEAN, error STRUCT<type:STRING,message:STRING,offset:BIGINT>, file_type STRING, details MAP<STRING,STRING>"
META = "original_name STRING, time TIMESTAMP, source STRING, valid BOOLEAN, additional_info MAP<STRING,STRING>"
FILES = "path STRING, size BIGINT, mtime TIMESTAMP, error STRING"

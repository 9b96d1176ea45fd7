"""leadmill: Spark jobs over web-sourced business records and text corpora."""

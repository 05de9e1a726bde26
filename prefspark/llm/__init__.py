"""Training-data operators. Nothing outside this subpackage imports it except ``__spark_entry__``."""

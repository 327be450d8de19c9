"""skein: a Spark-first engine for building, cleaning and measuring text corpora."""

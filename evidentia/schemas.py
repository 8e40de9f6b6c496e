"""Fixed schemas of the relations the engine reads and writes."""

from pyspark.sql import types as T

# Corpus table: eight columns, in this order. id..url and ingested_at are
# required; the vector may be null (documents not embedded yet).
PAPERS = T.StructType([
    T.StructField("id", T.StringType(), False),
    T.StructField("title", T.StringType(), False),
    T.StructField("authors", T.StringType(), False),
    T.StructField("published_date", T.DateType(), False),
    T.StructField("abstract", T.StringType(), False),
    T.StructField("url", T.StringType(), False),
    T.StructField("embedding", T.ArrayType(T.DoubleType(), False), True),
    T.StructField("ingested_at", T.TimestampType(), False),
])

REQUIRED_PAPER_COLUMNS = [f.name for f in PAPERS.fields if not f.nullable]

# Question ids are strings in question files ("A1", "P1", "U1", ...).
QUESTIONS = T.StructType([
    T.StructField("qid", T.StringType(), False),
    T.StructField("question", T.StringType(), True),
    T.StructField("expected_status", T.StringType(), True),
    T.StructField("notes", T.StringType(), True),
])

PRICING = T.StructType([
    T.StructField("model", T.StringType(), False),
    T.StructField("input", T.DoubleType(), False),
    T.StructField("output", T.DoubleType(), False),
])

# Atom feed entry, as read by the built-in XML source (rowTag = entry).
FEED_ENTRY = T.StructType([
    T.StructField("id", T.StringType(), True),
    T.StructField("title", T.StringType(), True),
    T.StructField("summary", T.StringType(), True),
    T.StructField("published", T.StringType(), True),
    T.StructField("author", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType(), True)])), True),
    T.StructField("category", T.ArrayType(T.StructType([
        T.StructField("_term", T.StringType(), True)])), True),
])

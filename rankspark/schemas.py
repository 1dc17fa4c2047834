"""Row shapes of the persistent tables and of parsed documents."""

from pyspark.sql import types as T

_s = T.StringType()

EXPERIENCE = T.StructType([T.StructField(n, _s) for n in ("organization", "role", "start", "end", "raw")])
EDUCATION = T.StructType([T.StructField(n, _s) for n in ("institution", "degree", "start", "end", "raw")])
PARSED = T.StructType(
    [
        *(T.StructField(n, _s) for n in ("name", "email", "phone")),
        T.StructField("languages_detected", T.ArrayType(_s)),
        T.StructField("skills", T.ArrayType(_s)),
        T.StructField("experience", T.ArrayType(EXPERIENCE)),
        T.StructField("education", T.ArrayType(EDUCATION)),
        T.StructField("category", _s),
    ]
)
VACANCIES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *(T.StructField(n, _s) for n in ("title", "experience", "description", "source_filename")),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("created_at", T.TimestampType()),
    ]
)
CANDIDATES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        *(T.StructField(n, _s) for n in ("name", "email", "source_file", "content_hash", "raw_text")),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("parsed", PARSED),
        T.StructField("created_at", T.TimestampType()),
    ]
)
LINES = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("line_no", T.IntegerType()),
        T.StructField("text", _s),
        T.StructField("max_font_size", T.DoubleType()),
        T.StructField("is_bold", T.BooleanType()),
        T.StructField("top", T.DoubleType()),
        T.StructField("col", T.IntegerType()),
        T.StructField("page", T.IntegerType()),
    ]
)
ENTITY = T.StructType([T.StructField("text", _s), T.StructField("label", _s), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("source", _s)])

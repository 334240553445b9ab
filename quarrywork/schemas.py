"""Fixed schemas; readers never infer one."""

from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())


def _struct(**kinds: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in kinds.items()])


CORPUS_RECORD = _struct(
    title=_S, author=_S, link=_S, text_extracted=_S, abstract=_S, genre=_S, tags=_A, indian_regions=_A, crop_types=_A, farming_methods=_A,
    soil_types=_A, climate_info=_A, fertilizers=_A, watering_schedule=_S, plant_species=_A, data_type=_S, publication_year=T.IntegerType(),
    source_domain=_S, extraction_timestamp=_S, relevance_score=T.DoubleType(), content_length=T.LongType(), content_hash=_S, url_hash=_S, pdf_path=_S,
    is_pdf=T.BooleanType(),
)
REQUIRED = tuple(f.name for f in CORPUS_RECORD if f.name not in ("author", "watering_schedule", "publication_year", "pdf_path"))
SEARCH_RESULT = _struct(query=_S, rank=T.IntegerType(), href=_S, title=_S, body=_S)
LLM_ANALYSIS = _struct(
    domain=_S, relevance_score=T.DoubleType(), key_insights=_A, indian_context=_S, actionable_info=_S, data_points=_A, geographic_relevance=_A
)
DEDUP_STATE = _struct(kind=_S, key=_S, url=_S, ts=_S, success=T.BooleanType())
VERSION = _struct(version=T.LongType(), path=_S, created=_S, current=T.BooleanType())

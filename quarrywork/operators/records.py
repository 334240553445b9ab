"""Search hits to corpus records: one projection, so Catalyst fuses all of a record's expressions."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, functions as F

from .. import lexicon as L
from ..functions import classify as C, content as T, scoring as S, text as X, urls as U
from ..schemas import CORPUS_RECORD


@dataclass(frozen=True)
class Lexicons:
    """The word lists that a record is made with."""

    regions: tuple[str, ...] = L.STATES
    crops: tuple[str, ...] = L.CROPS
    methods: tuple[str, ...] = L.METHODS
    soils: tuple[str, ...] = L.SOILS
    climates: tuple[str, ...] = L.CLIMATES
    fertilizers: tuple[str, ...] = L.FERTILIZERS
    species: tuple[str, ...] = L.SPECIES
    relevance: tuple[str, ...] = L.RELEVANCE_TERMS
    places: tuple[str, ...] = L.PLACE_TERMS
    saturating: tuple[str, ...] = L.SATURATING_TERMS
    context: tuple[str, ...] = L.CONTEXT_TERMS
    tags: dict[str, tuple[str, ...]] = field(default_factory=lambda: dict(L.TAGS))


def _text(name: str) -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def from_hits(hits: DataFrame, lexicons: Lexicons = Lexicons(), at: Column | None = None, most: int = 500) -> DataFrame:
    """Hits (href, title, body, and full_content where the page was read) to records of the corpus.

    A hit without URL or title gives no record.  Without content the snippet stands for it.  ``at`` is
    the time of the run (now, if not given).  Further columns are dropped.
    """
    rows = hits.where((_text("href") != "") & (_text("title") != ""))
    full = F.coalesce(F.nullif(F.col("full_content"), F.lit("")), _text("body")) if "full_content" in hits.columns else _text("body")
    rows = rows.select("href", "title", F.col("body").alias("snippet"), full.alias("full"))
    whole = F.concat_ws(" ", "full", "title", _text("snippet"))
    genre = C.genre("href", "title", _text("snippet"))
    pdf = F.lower("href").contains("pdf")
    none = lambda kind: F.lit(None).cast(kind)
    made = {
        "title": F.col("title"), "author": none("string"), "link": F.col("href"), "text_extracted": F.col("full"),
        "abstract": F.when(_text("snippet") != "", F.substring("snippet", 1, most)), "genre": genre,
        "tags": C.tags(whole, (genre,), lexicons.tags), "indian_regions": X.matches(whole, lexicons.regions), "crop_types": X.matches(whole, lexicons.crops),
        "farming_methods": X.matches(whole, lexicons.methods), "soil_types": X.matches(whole, lexicons.soils), "climate_info": X.matches(whole, lexicons.climates),
        "fertilizers": X.matches(whole, lexicons.fertilizers), "watering_schedule": T.watering(whole), "plant_species": X.matches(whole, lexicons.species),
        "data_type": F.lit("mixed"), "publication_year": none("int"), "source_domain": F.lower(U.netloc("href")),
        "extraction_timestamp": F.date_format(at if at is not None else F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"),
        "relevance_score": S.occurrence(whole, lexicons.relevance, lexicons.places), "content_length": F.length("full").cast("long"),
        "content_hash": F.md5("full"), "url_hash": F.md5("href"), "pdf_path": none("string"), "is_pdf": pdf,
    }
    return rows.select(*[made[f.name].cast(f.dataType).alias(f.name) for f in CORPUS_RECORD])


def defaulted(results: DataFrame) -> DataFrame:
    """Results under their own names (url, full_content, snippet, ...) to records: what is missing or null
    gets the record's default."""
    have = set(results.columns)
    named = lambda *names: [F.col(n) for n in names if n in have]
    empty = F.array().cast("array<string>")
    texts = {"title": ("title",), "link": ("url",), "text_extracted": ("full_content", "snippet"), "genre": ("genre",), "source_domain": ("source_domain",), "content_hash": ("content_hash",), "url_hash": ("url_hash",)}
    out = []
    for f in CORPUS_RECORD:
        if f.name in texts:
            value = F.coalesce(*named(*texts[f.name]), F.lit("article" if f.name == "genre" else ""))
        elif f.name == "abstract":
            value = F.coalesce(*[F.when(c != "", F.substring(c, 1, 500)) for c in named("snippet")], F.lit(None))
        elif f.name == "data_type":
            value = F.lit("mixed")
        elif f.name == "is_pdf":
            value = F.coalesce(*named("is_pdf"), F.lit(False))
        elif f.name in ("relevance_score", "content_length"):
            value = F.coalesce(*named(f.name), F.lit(0))
        elif f.dataType.simpleString() == "array<string>":
            value = F.coalesce(*named(f.name), empty)
        else:
            value = F.coalesce(*named(f.name), F.lit(None))
        out.append(value.cast(f.dataType).alias(f.name))
    return results.select(*out)


def with_search_scores(records: DataFrame, query: str, agent: Column, lexicons: Lexicons = Lexicons()) -> DataFrame:
    """Records with how they were found and what they are worth: strategy of the query, category,
    richness, relevance and context scores."""
    text = F.concat_ws(" ", _text("title"), _text("text_extracted"))
    return records.withColumns({
        "autonomous_search": F.lit(True), "agent_specialization": agent, "search_query_generated": F.col(query), "search_strategy": C.strategy(query),
        "content_category": C.category("link", "title", "is_pdf"),
        "data_richness_score": S.richness(*[F.col(c) for c in ("tags", "indian_regions", "crop_types", "soil_types", "climate_info", "fertilizers", "farming_methods")]),
        "agriculture_relevance": S.saturating(text, lexicons.saturating), "indian_context_score": S.presence(text, lexicons.context, [r.lower() for r in lexicons.regions[:10]]),
    })


def with_extractions(hits: DataFrame, pages: DataFrame, url: str = "url") -> DataFrame:
    """Hits with what was extracted from their pages (url, success, content, title, author, publish_date):
    content, author, date and word count are the page's where it was read, and its title where it has
    one; other hits keep their snippet.  A page is joined by its first extraction."""
    read = pages.where("success").groupBy(F.col(url).alias("__url")).agg(F.min(F.struct("content", "title", "author", "publish_date")).alias("__page"))
    out = hits.join(read, F.col(url) == F.col("__url"), "left")
    done, page = F.col("__page").isNotNull(), F.col("__page")
    return out.withColumns({
        "content": F.when(done, page["content"]).otherwise(_text("snippet")), "title": F.when(done & (F.coalesce(page["title"], F.lit("")) != ""), page["title"]).otherwise(F.col("title")),
        "author": page["author"], "publish_date": page["publish_date"], "word_count": F.when(done, X.word_count(page["content"])), "extracted": done,
    }).drop("__url", "__page")


def with_model_analysis(records: DataFrame, analysis: str, text: str = "text_extracted", least: float = 0.7) -> DataFrame:
    """Records with a model's analysis (a struct column; null where the model failed): summary of 500
    characters, and score and mark of high quality where the model's relevance is above ``least``."""
    score = F.col(f"{analysis}.relevance_score")
    done = F.col(analysis).isNotNull()
    summary = F.when(F.length(text) > 500, F.concat(F.substring(text, 1, 500), F.lit("..."))).otherwise(F.col(text))
    return records.withColumns({"enhanced_by_llm": done, "content_summary": F.when(done, summary), "high_quality": F.coalesce(score > least, F.lit(False)), "quality_score": F.when(score > least, score)})


def model_or_rules(rows: DataFrame, model: str, rules: str, out: str = "record") -> DataFrame:
    """The model's struct where there is one, else the rules'."""
    return rows.withColumn(out, F.coalesce(F.col(model), F.col(rules)))

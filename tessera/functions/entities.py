"""Entity JSON parsing, filtering, weighting.

The entity documents are JSON text ``[{"entities": [...]}, ...]``; only element 0
is read, as in the reference.  Parsing is one ``from_json`` per field followed by
``transform``/``flatten``/``explode`` -- all JVM-side, no UDF.
"""

from __future__ import annotations

from typing import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ENTITY_JSON_SCHEMA = (
    "array<struct<entities: array<struct<"
    "name: string, type: string, salience: double, text: string, "
    "mentions: array<struct<text: struct<content: string>, type: string>>>>>>"
)

ENTITY_FIELDS = ("text", "seo_title", "kicker_headline")

# Fixed values (reference semantics): field weights of the production flow,
# the evaluation notebook and the presentation notebook; the brand word that
# disqualifies an entity; entity types that are dropped.
FLOW_WEIGHTS = {"text": 1, "seo_title": 3, "kicker_headline": 6}
EVAL_WEIGHTS = {"text": 1, "seo_title": 2, "kicker_headline": 3}
PRESENTATION_WEIGHTS = {"text": 1, "kicker_headline": 2, "seo_title": 3}
BRAND_WORD = "bild"
DROPPED_TYPE_PARTS = ("UNKNOWN", "NUMBER")
DEFAULT_ENTITY_TYPE = "COMMON"


def _entity_list(json_col: Column) -> Column:
    """Element 0's ``entities`` array of the parsed JSON document."""
    doc = F.from_json(json_col, ENTITY_JSON_SCHEMA)
    return F.try_element_at(doc, F.lit(1)).getField("entities")


def _is_json_object(c: Column) -> Column:
    return F.startswith(F.ltrim(c), F.lit("{")) & F.get_json_object(c, "$.content").isNotNull()


def parse_entity_array(json_col: Column, form: str = "any") -> Column:
    """``array<struct<text, type, salience>>`` for one entity JSON document.

    form="name" (F11): ``{text: name, type}`` per entity (salience kept).
    form="any"  (F12): type and text present -> name if text is a string, else
    ``text.content``; no type but mentions -> one element per mention with the
    mention's type and the entity's salience; otherwise name with its type
    (null when absent).
    """
    ents = F.coalesce(_entity_list(json_col), F.array())

    def out(text, typ, sal):
        return F.struct(text.alias("text"), typ.alias("type"), sal.cast("double").alias("salience"))

    if form == "name":
        return F.transform(ents, lambda e: out(e["name"], e["type"], e["salience"]))
    if form != "any":
        raise ValueError(f"unknown entity form {form!r}")
    return F.flatten(F.transform(ents, lambda e: (
        F.when(e["type"].isNotNull() & e["text"].isNotNull(),
               F.array(out(F.when(_is_json_object(e["text"]), F.get_json_object(e["text"], "$.content"))
                            .otherwise(e["name"]), e["type"], e["salience"])))
         .when(e["type"].isNull() & e["mentions"].isNotNull(),
               F.transform(e["mentions"], lambda m: out(m["text"]["content"], m["type"], e["salience"])))
         .otherwise(F.array(out(e["name"], e["type"], e["salience"]))))))


def parse_entities(df: DataFrame, key: str = "article_uid", fields: Sequence[str] = ENTITY_FIELDS,
                   form: str = "any", distinct: bool = True, drop_brand: bool | None = None) -> DataFrame:
    """Long entity table ``(key, field, text, type, salience)``.

    The three JSON columns are unpivoted (one row per article and field), parsed
    and exploded.  ``distinct`` removes identical entities within one document
    (the reference's ``deduplicate`` default).  For form="name" entities whose
    name contains the brand word are dropped (F11).
    """
    if drop_brand is None:
        drop_brand = form == "name"
    long = df.select(key, *fields).unpivot([key], list(fields), "field", "json")
    ents = long.select(key, "field", F.explode(parse_entity_array(F.col("json"), form)).alias("e"))
    out = ents.select(key, "field", "e.text", "e.type", "e.salience")
    if drop_brand:
        out = out.filter(~F.contains(F.lower(F.col("text")), F.lit(BRAND_WORD)))
    if distinct:
        out = out.dropDuplicates([key, "field", "text", "type", "salience"])
    return out


def default_type(c: Column, default: str = DEFAULT_ENTITY_TYPE) -> Column:
    """missing type -> 'COMMON'."""
    return F.coalesce(c, F.lit(default))


def filter_entities(df: DataFrame, text: str = "text", typ: str = "type",
                    dropped_types: Sequence[str] | None = None) -> DataFrame:
    """keep typed entities whose text lacks the brand word and whose type
    contains none of UNKNOWN / NUMBER (or, with ``dropped_types``, is not one of
    the given types exactly -- the notebooks' NUMBER/COMMON rule)."""
    cond = F.col(typ).isNotNull() & ~F.contains(F.lower(F.col(text)), F.lit(BRAND_WORD))
    if dropped_types is None:
        for part in DROPPED_TYPE_PARTS:
            cond = cond & ~F.contains(F.col(typ), F.lit(part))
    else:
        cond = cond & ~F.col(typ).isin(list(dropped_types))
    return df.filter(cond)


def normalize_term(c: Column) -> Column:
    """F16: lower case, dots removed."""
    return F.replace(F.lower(c), F.lit("."), F.lit(""))


def weight_entities(df: DataFrame, weights: Mapping[str, int] = FLOW_WEIGHTS,
                    field: str = "field") -> DataFrame:
    """repeat factor per field as a ``weight`` column (no row repetition);
    fields with weight 0 or absent are dropped."""
    expr = None
    for f, w in weights.items():
        expr = F.when(F.col(field) == f, F.lit(int(w))) if expr is None else expr.when(F.col(field) == f, F.lit(int(w)))
    return df.withColumn("weight", expr.otherwise(F.lit(0))).filter(F.col("weight") > 0)


def entity_texts(arr: Column) -> Column:
    """the ``text`` of every entity struct in an array."""
    return F.transform(arr, lambda e: e["text"])


def dedupe_keep_last(arr: Column) -> Column:
    """order-preserving de-duplication that keeps the *last* occurrence."""
    return F.reverse(F.array_distinct(F.reverse(arr)))


def description_words(c: Column) -> Column:
    """``"['a', 'b']"`` or ``"a, b"`` -> array of words."""
    stripped = F.replace(F.replace(c, F.lit("['"), F.lit("")), F.lit("']"), F.lit(""))
    return F.split(stripped, ", ", -1)


def filter_score(df: DataFrame, score: str = "score", threshold: float = 0.70) -> DataFrame:
    """keep recognised entity spans scored above the threshold."""
    return df.filter(F.col(score) > threshold)

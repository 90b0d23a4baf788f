"""Models that plug in (U2): an encoder for V1 and an entity recogniser in front of F12 and F18."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tessera.functions import entities as E
from tessera.operators import embed as EM
from tessera.operators import recognise as RC
from tessera.plans.oracle_views import with_views
from tessera.plans.registry import register
from tessera.sources import fixtures as FX


class LetterEncoder:
    """Shares of the letters a to z among a text's characters: a model small enough for a SQL twin."""

    def encode(self, texts: list[str]) -> np.ndarray:
        return np.array([[t.count(chr(97 + k)) / max(len(t), 1) for k in range(26)] for t in texts])


def _rules():
    return RC.RuleRecogniser(FX.ENTITY_TOKEN_PATTERN, FX.ENTITY_TYPES_BY_LENGTH_MOD_5)


_TYPE = "CASE length(w) % 5 " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(FX.ENTITY_TYPES_BY_LENGTH_MOD_5) if t) + " END"
_FOUND = ("found", f"""
    SELECT article_uid, w AS text, {_TYPE} AS type, 1 - 1.0 / length(w) AS score, CAST(pos - 1 AS INTEGER) AS pos FROM (
      SELECT article_uid, unnest(ws) AS w, generate_subscripts(ws, 1) AS pos FROM (
        SELECT article_uid, regexp_extract_all(text, '{FX.ENTITY_TOKEN_PATTERN}') AS ws FROM articles))""")


@register("embed_with", with_views(["articles"], select="""
    SELECT article_uid, CAST(k AS INTEGER) AS letter,
           round((length(t) - length(replace(t, chr(97 + CAST(k AS INTEGER)), ''))) / greatest(length(t), 1), 9) AS share
    FROM (SELECT article_uid, coalesce(text, '') AS t FROM articles), range(26) AS r(k)"""))
def q_embed_with(spark, base):
    """V1 through the plug-in: every coordinate of every article."""
    vec = EM.embed_with(FX.articles(spark, base).select("article_uid", "text"), LetterEncoder, key="article_uid", dim=26)
    return (vec.select("article_uid", F.posexplode("vec").alias("letter", "share"))
            .select("article_uid", "letter", F.round("share", 9).alias("share")))


@register("recognise_entities", with_views(["articles"], [_FOUND], """
    SELECT article_uid, pos, text, type, round(score, 9) AS score FROM found WHERE score > 0.8
      AND type IS NOT NULL AND NOT contains(lower(text), 'bild') AND NOT contains(type, 'NUMBER')"""))
def q_recognise_entities(spark, base):
    """Recognised spans of every text above a score, of a wanted type."""
    found = RC.recognise_with(FX.articles(spark, base).select("article_uid", "text"), _rules, key="article_uid")
    kept = E.filter_entities(E.filter_score(RC.spans(found, "article_uid"), threshold=0.8))
    return kept.select("article_uid", "pos", "text", "type", F.round("score", 9).alias("score"))


@register("recognised_json", with_views(["articles"], [_FOUND], """
    SELECT DISTINCT article_uid, 'text' AS field, text, type, round(score, 9) AS salience FROM found"""))
def q_recognised_json(spark, base):
    """Recognised spans written as entity JSON and parsed as any other."""
    found = RC.recognise_with(FX.articles(spark, base).select("article_uid", "text"), _rules, key="article_uid")
    parsed = E.parse_entities(found.select("article_uid", RC.entity_json(F.col("entities")).alias("text")), fields=["text"])
    return parsed.select("article_uid", "field", "text", "type", F.round("salience", 9).alias("salience"))

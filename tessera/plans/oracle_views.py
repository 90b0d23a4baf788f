"""The fixture views of ``tessera.sources.fixtures`` written as DuckDB CTEs.

Only used to build ``oracle_sql()`` strings: each registered query's SQL twin
starts with the CTEs it needs (dependencies are pulled in automatically).
Regular expressions are written with explicit classes so that Java and RE2
read them the same way.
"""

from __future__ import annotations

from typing import Iterable, Sequence

from tessera.functions import entities as E
from tessera.sources import fixtures as FX

_TYPES_CASE = "CASE length(text) % 5 " + " ".join(
    f"WHEN {i} THEN '{t}'" for i, t in enumerate(FX.ENTITY_TYPES_BY_LENGTH_MOD_5) if t is not None) + " END"

VIEWS: dict[str, tuple[Sequence[str], str]] = {
    "articles": ((), f"""
        SELECT d.doc_id AS article_uid,
               split_part(d.text, chr(10), 1) AS headline,
               split_part(d.text, chr(10), 1) || ' - ' || d.source || '{FX.SEO_SUFFIX}' AS seo_title,
               d.text AS text, d.source AS department, e.ts AS created_at,
               e.value > 50 AS is_premium, md5(d.text) AS content_key
        FROM documents d LEFT JOIN events e ON e.event_id = d.doc_id"""),
    "article_labels": ((), f"""
        SELECT vec_id AS article_uid,
               CAST(CASE WHEN label = {FX.OUTLIER_TOPIC} THEN -1 ELSE label END AS INTEGER) AS topic_label
        FROM embeddings"""),
    "article_vectors": (("articles",), """
        SELECT a.article_uid, m.embedding, a.created_at AS article_created_at
        FROM articles a JOIN embeddings m ON m.vec_id = a.article_uid"""),
    "entity_tokens": (("articles",), f"""
        SELECT article_uid, field, unnest(toks) AS text, generate_subscripts(toks, 1) AS pos FROM (
          SELECT article_uid, field,
                 regexp_extract_all(val, '{FX.ENTITY_TOKEN_PATTERN}') AS toks
          FROM (SELECT article_uid, 'text' AS field, text AS val FROM articles
                UNION ALL SELECT article_uid, 'seo_title', seo_title FROM articles
                UNION ALL SELECT article_uid, 'kicker_headline', headline FROM articles))"""),
    "entities_long": (("entity_tokens",), f"""
        SELECT DISTINCT article_uid, field, text, {_TYPES_CASE} AS type, 1.0 / pos AS salience
        FROM entity_tokens"""),
    "page_views": ((), """
        SELECT user_id AS article_uid, count(*) AS PageViews FROM events
        WHERE event_type = 'view' GROUP BY user_id"""),
    "posts": ((), """
        SELECT user_id AS ID_Article, CASE WHEN event_type = 'error' THEN 'deleted' ELSE 'online' END AS Status
        FROM events WHERE event_type IN ('error', 'click')"""),
    "pairs": (("articles",), """
        SELECT article_uid, headline,
               CASE WHEN strpos(text, chr(10)) > 0 THEN split_part(text, chr(10), 2) END AS seo_title
        FROM articles"""),
    # ---- topic descriptions (D1, D3, D4) over the entity view
    "weighted": (("article_labels", "entities_long"), f"""
        SELECT l.topic_label, e.article_uid, e.field, replace(lower(e.text), '.', '') AS term,
               CASE e.field {" ".join(f"WHEN '{f}' THEN {w}" for f, w in E.FLOW_WEIGHTS.items())} END AS weight
        FROM article_labels l JOIN entities_long e ON e.article_uid = l.article_uid
        WHERE e.type IS NOT NULL AND NOT contains(lower(e.text), 'bild')
          AND NOT contains(e.type, 'UNKNOWN') AND NOT contains(e.type, 'NUMBER')"""),
    "counts": (("weighted",), """
        SELECT topic_label, term, CAST(sum(weight) AS BIGINT) AS n FROM weighted GROUP BY topic_label, term"""),
    "totals": (("counts",), "SELECT term, sum(n) AS term_total FROM counts GROUP BY term"),
    "scored0": (("counts", "totals", "article_labels"), """
        SELECT c.topic_label, c.term, c.n,
               c.n * ln(CAST((SELECT count(*) FROM article_labels) AS DOUBLE) / t.term_total) AS s
        FROM counts c JOIN totals t ON t.term = c.term"""),
    "norms": (("scored0",), "SELECT topic_label, sum(abs(s)) AS l1 FROM scored0 GROUP BY topic_label"),
    "scored": (("scored0", "norms"), """
        SELECT s.topic_label, s.term, s.n, s.s, CASE WHEN l1 > 0 THEN s.s / l1 ELSE 0.0 END AS score
        FROM scored0 s JOIN norms USING (topic_label)"""),
    "ranked": (("scored",), """
        SELECT *, row_number() OVER (PARTITION BY topic_label ORDER BY score DESC, term ASC) AS rk FROM scored"""),
    "topic_words": (("ranked",), """
        SELECT topic_label, string_agg(term, ', ' ORDER BY rk) AS words FROM ranked WHERE rk <= 10
        GROUP BY topic_label"""),
    "topic_table": (("article_labels", "topic_words"), """
        SELECT CAST(s.topic_label AS INTEGER) AS topic_label, coalesce(w.words, '') AS topic_desc,
               CAST(s.topic_size AS BIGINT) AS topic_size
        FROM (SELECT topic_label, count(article_uid) AS topic_size FROM article_labels GROUP BY topic_label) s
        LEFT JOIN topic_words w USING (topic_label)"""),
    # ---- the dashboard's per-article table (Q1-Q5)
    "topic_page_views": (("article_labels", "articles", "topic_table", "page_views"), """
        SELECT l.topic_label, t.topic_desc, t.topic_size, a.article_uid, a.headline AS title, a.created_at,
               CAST(coalesce(v.PageViews, 0) AS BIGINT) AS PageViews
        FROM article_labels l JOIN articles a ON a.article_uid = l.article_uid
        JOIN topic_table t ON t.topic_label = l.topic_label
        LEFT JOIN page_views v ON v.article_uid = a.article_uid
        WHERE l.topic_label <> -1"""),
}


def _resolve(names: Iterable[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for dep in VIEWS[n][0]:
            visit(dep)
        order.append(n)

    for n in names:
        visit(n)
    return order


def with_views(views: Iterable[str], ctes: Sequence[tuple[str, str]] = (), select: str = "",
               recursive: bool = False) -> str:
    """``WITH <views...>, <ctes...> <select>`` as one DuckDB statement."""
    parts = [f"{n} AS ({VIEWS[n][1]})" for n in _resolve(views)]
    parts += [f"{n} AS ({body})" for n, body in ctes]
    head = (("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts) + "\n") if parts else ""
    return head + select

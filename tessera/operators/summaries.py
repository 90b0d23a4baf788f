"""Topic summaries by graph ranking (D7, D8), for all topics in one plan.

D8 ``topic_keywords``: word graph per topic (undirected edges between adjacent
kept tokens of one document, weighted by co-occurrence count), PageRank with
damping 0.85 until no topic's ranks move by more than a tolerance, then the best
max(1, floor(0.01 * distinct words)) words.  The graph is undirected, so the walk's eigenvalues are
real and Chebyshev's semi-iteration takes about a third of the power method's rounds; ranks start at
the words' shares of all edge weight, where an undirected walk without teleport ends.  Edges are
stored once, bucketed by their source: a round moves ranks and partial sums, never edges.  Some rounds
make one job, whose ranks are written and the ones before deleted.

D7 ``topic_abstract``: the most central sentence of each topic.  Sentence
similarity is (1 + cos) / 2 -- non-negative, symmetric and linear in each
vector -- so the stationary distribution of LexRank's walk is proportional to
the row sums, which need only per-topic sums (a count and one d-vector), never
the pairs of a topic: exact, no cap on sentences, O(n * d), skew-proof partial
aggregates.  (The reference thresholds raw cosine over the full pair matrix of
a topic and power-iterates.)

D7 by cosine, ``central_sentence``: term weights are not negative, so neither is
any cosine and no floor is needed.  W = X X^T is symmetric, so the walk's limit
from the uniform start is, within each connected part of a topic, proportional
to the row sums X (X^T 1): two aggregates over (sentence, term) rows.  Each part
keeps its share of the topic's sentences; parts come from stars around each
term's least sentence.  No pairs, no cap, no rounds but those of the components.
"""

from __future__ import annotations

from typing import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.functions import text as TX
from tessera.functions import vectors as VF
from tessera.operators.graph import connected_components
from tessera.session import bucketed, drop, drop_bucketed, hold

NONE_TOPIC_TEXT = " NONE "
DAMPING = 0.85


def word_graph(tokens: DataFrame, topic: str = "topic_label", toks: str = "t") -> DataFrame:
    """``(topic, src, dst, w)`` from per-document token arrays, both directions."""
    pairs = tokens.select(topic, F.explode(F.arrays_zip(F.slice(toks, 1, F.greatest(F.size(toks) - 1, F.lit(0))),
                                                        F.slice(toks, 2, F.greatest(F.size(toks) - 1, F.lit(0))))).alias("p"))
    e = pairs.select(topic, F.least("p.0", "p.1").alias("a"), F.greatest("p.0", "p.1").alias("b")).filter(F.col("a") != F.col("b"))
    e = e.groupBy(topic, "a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))  # (each pair is counted once, then turned)
    both = F.array(F.struct(F.col("a").alias("src"), F.col("b").alias("dst")), F.struct(F.col("b").alias("src"), F.col("a").alias("dst")))
    return e.select(topic, "w", F.explode(both).alias("e")).select(topic, "e.src", "e.dst", "w")


def pagerank(nodes: DataFrame, edges: DataFrame, topic: str = "topic_label", tolerance: float = 1e-6,
             damping: float = DAMPING, rounds_per_job: int = 4, max_rounds: int = 500) -> DataFrame:
    """Per-topic PageRank: ``(topic, word, pr)``; nodes ``(topic, word)``, edges ``(topic, src, dst, w)`` in
    both directions.  Teleport is uniform within the topic; a word without edges keeps its teleport
    share.  Runs until the ranks' summed residual (what a plain round would move) is at most
    ``tolerance`` in every topic; raises if it never is."""
    number = lambda word: F.xxhash64(topic, word)  # noqa: E731  (rounds move 64-bit numbers, no words)
    e = bucketed(edges.select(number("src").alias("src"), number("dst").alias("dst"), "w"), ["src"], "graph")
    weight = e.groupBy("src").agg(F.sum("w").alias("ow"))  # (carried by the words: edges are shuffled once)
    t = nodes.select(topic, "word", number("word").alias("id")).join(weight.withColumnRenamed("src", "id"), "id", "left")
    total = t.groupBy(topic).agg(F.count(F.lit(1)).cast("double").alias("n"), F.count("ow").alias("tied"), F.sum("ow").alias("all"))
    start = F.coalesce(F.col("ow") / F.col("all") * F.col("tied") / F.col("n"), (1 - damping) / F.col("n"))
    cur = hold(t.join(total, topic).select("id", topic, "n", "ow", start.alias("y"), start.alias("was")), "ranks")
    omega, rounds = 1.0, 0
    while rounds < max_rounds:
        t = cur
        for _ in range(rounds_per_job):
            flow = (e.join(t.select(F.col("id").alias("src"), (F.col("y") / F.col("ow")).alias("out")), "src")
                    .groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("w") * F.col("out")).alias("inflow")))
            plain = (1 - damping) / F.col("n") + damping * F.coalesce("inflow", F.lit(0.0))
            t = (t.select("id", topic, "n", "ow", "y", "was").join(flow, "id", "left")
                 .select("id", topic, "n", "ow", (omega * (plain - F.col("was")) + F.col("was")).alias("y"), F.col("y").alias("was"),
                         F.abs(plain - F.col("y")).alias("residual")))
            omega = 1 / (1 - damping ** 2 * omega / (2 if rounds == 0 else 4))
            rounds += 1
        new = hold(t, "ranks")
        left = new.groupBy(topic).agg(F.sum("residual").alias("d")).agg(F.max("d")).first()[0]
        drop(cur)
        cur = new
        if left is None or left <= tolerance:
            drop_bucketed(e)
            return (nodes.select(topic, "word", number("word").alias("id")).join(cur.select("id", "y"), "id")
                    .select(topic, "word", F.col("y").alias("pr")))
    raise RuntimeError(f"PageRank did not settle within {max_rounds} rounds")


def topic_keywords(tokens: DataFrame, topic: str = "topic_label", tolerance: float = 1e-6,
                   share: float = 0.01) -> DataFrame:
    """``(topic, rank, word, score)`` -- best share of words per topic."""
    tokens = hold(tokens.select(topic, F.col("t")), "tokens")
    edges = word_graph(tokens, topic)
    nodes = hold(tokens.select(topic, F.explode("t").alias("word")).distinct(), "nodes")
    pr = pagerank(nodes, edges, topic, tolerance)
    drop(tokens)
    sizes = nodes.groupBy(topic).agg(F.count(F.lit(1)).alias("nw"))
    w = Window.partitionBy(topic).orderBy(F.col("pr").desc(), F.col("word"))
    ranked = pr.withColumn("rank", F.row_number().over(w))
    return (ranked.join(sizes, topic).filter(F.col("rank") <= F.greatest(F.lit(1), F.floor(F.col("nw") * share)))
            .select(topic, F.col("rank").cast("int").alias("rank"), "word", F.round("pr", 6).alias("score")))


def topic_sums(x: DataFrame, topic: str, dim: int) -> DataFrame:
    """``(topic, n, S)``: rows of each topic and the sum of their vectors ``x`` (null elements add nothing)."""
    def run(batches):
        sums = {}
        for batch in batches:
            codes = batch.column(topic).dictionary_encode()
            rows = batch.column("x").flatten().fill_null(0.0).to_numpy(zero_copy_only=False).reshape(batch.num_rows, dim)
            at = codes.indices.to_numpy()
            for k, name in enumerate(codes.dictionary.to_pylist()):
                mine = rows[at == k]
                n, total = sums.get(name, (0, 0.0))
                sums[name] = (n + len(mine), total + mine.sum(0))
        if sums:
            yield pa.RecordBatch.from_arrays([
                pa.array(list(sums), kind), pa.array([float(n) for n, _ in sums.values()]),
                pa.array([s for _, s in sums.values()], pa.list_(pa.float64()))], [topic, "n", "s"])

    field = x.schema[topic].dataType
    kind = to_arrow_type(field)
    parts = x.filter(F.col(topic).isNotNull()).select(topic, "x").mapInArrow(run, f"{topic} {field.simpleString()}, n double, s array<double>")
    each = parts.select(topic, "n", F.posexplode("s").alias("k", "v")).groupBy(topic, "k").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    return each.groupBy(topic).agg(F.max("n").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("k", "v"))), lambda t: t["v"]).alias("S"))


def topic_abstract(sent: DataFrame, topic: str = "topic_label", key: str = "sid", vec: str = "vec",
                   text: str = "sentence", order: Sequence[str] = ("pos",), dim: int = 64) -> DataFrame:
    """``(topic, sentence, score)``, the most central sentence per topic.

    ``sent`` has one row per sentence with a unit vector ``vec`` of length
    ``dim``; ties go to the smaller ``order`` columns, then key.  The similarity
    w(i,j) = (1 + x_i.x_j)/2 is symmetric, so the stationary distribution of
    the row-normalised walk (the limit of LexRank's power iteration) is
    proportional to the row sums by detailed balance:
    score(i) = rowsum(i) / sum_j rowsum(j), rowsum(i) = (n + x_i.S)/2 with S the
    topic's vector sum, so all rowsums of a topic add up to (n^2 + S.S)/2.  One pass of per-topic sums
    (in numpy for each task, then the tasks' few rows); no pairs, no rounds."""
    x = sent.select(topic, key, text, *order, F.col(vec).cast("array<double>").alias("x"))
    x = x.filter(F.size("x") == dim)
    tot = topic_sums(x, topic, dim)
    scored = x.join(tot, topic).select(topic, key, text, *order, ((F.col("n") + VF.dot(F.col("x"), F.col("S")))
                                       / (F.col("n") * F.col("n") + VF.dot(F.col("S"), F.col("S")))).alias("v"))
    w = Window.partitionBy(topic).orderBy(F.col("v").desc(), *order, key)
    best = scored.withColumn("r", F.row_number().over(w)).filter(F.col("r") == 1)
    return best.select(topic, F.col(text).alias("sentence"), F.round("v", 6).alias("score"))


def sentence_weights(sent: DataFrame, topic: str = "topic_label", key: str = "sid", text: str = "sentence") -> DataFrame:
    """``(topic, key, term, x)``: unit TF-IDF vectors of sentences, the idf over all of them
    (ln((N+1)/(df+1)) + 1).  A sentence without a term has no row."""
    # sentences are dealt by key, so that their terms are counted where they are cut
    dealt = sent.filter(F.col(topic).isNotNull() & F.col(key).isNotNull()).select(topic, key, text).repartition(topic, key)
    toks = hold(dealt.select(topic, key, F.explode(TX.vectorizer_tokens(text)).alias("term"))
                .groupBy(topic, key, "term").agg(F.count(F.lit(1)).cast("double").alias("tf")), "terms")
    n = sent.agg(F.count(F.lit(1))).scalar()
    idf = toks.groupBy("term").agg((F.ln((n + 1) / (F.count(F.lit(1)) + 1)) + 1).alias("idf"))
    w = toks.join(idf, "term").select(topic, key, "term", (F.col("tf") * F.col("idf")).alias("w"))
    w = w.repartition(topic, key).groupBy(topic, key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("len"),
                                                          F.collect_list(F.struct("term", "w")).alias("t"))
    w = w.select(topic, key, "len", F.explode("t").alias("t"))
    out = hold(w.select(topic, key, "t.term", (F.col("t.w") / F.col("len")).alias("x")), "unit")
    drop(toks)
    return out


def sentence_scores(weights: DataFrame, topic: str = "topic_label", key: str = "sid") -> DataFrame:
    """``(topic, key, v)``: where the walk over cosines ends from the uniform start.  ``weights`` as by
    ``sentence_weights``; a topic's v add up to 1."""
    by_term = weights.groupBy(topic, "term").agg(F.sum("x").alias("s"), F.min(key).alias("least"))
    tied = weights.join(by_term, [topic, "term"]).select(topic, key, "least", (F.col("x") * F.col("s")).alias("d"))
    number = lambda c: F.xxhash64(topic, c)  # noqa: E731  (a key may occur in several topics)
    # a sentence ties its terms' least sentences to each other and belongs to their part: the graph's vertices
    # are those alone, one a term at most
    degree = hold(tied.repartition(topic, key).groupBy(topic, key)
                  .agg(F.sum("d").alias("d"), F.min("least").alias("first"), F.collect_set("least").alias("all")), "degree")
    ties = degree.select(number("first").alias("src"), topic, F.explode("all").alias("one")).select("src", number("one").alias("dst"))
    ties = hold(ties.distinct(), "ties")
    parts = connected_components(ties.select(F.col("dst").alias("id")), ties)
    t = hold(degree.withColumn("id", number("first")).join(parts, "id").select(topic, key, "comp", "d"), "parts")
    drop(degree, ties, parts)
    share = t.groupBy(topic, "comp").agg(F.count(F.lit(1)).alias("m"), F.sum("d").alias("all"))
    size = t.groupBy(topic).agg(F.count(F.lit(1)).alias("n"))
    return (t.join(share, [topic, "comp"]).join(size, topic)
            .select(topic, key, (F.col("d") / F.col("all") * F.col("m") / F.col("n")).alias("v")))


def central_sentence(sent: DataFrame, topic: str = "topic_label", key: str = "sid", text: str = "sentence",
                     order: Sequence[str] = ("pos",)) -> DataFrame:
    """D7 by cosine: ``(topic, sentence, score)``, the most central sentence of each topic.  Equal
    scores (to 12 places) go to the smaller ``order`` columns, then key; sentences without a term cannot win,
    and a topic of none but those has no row."""
    weights = sentence_weights(sent, topic, key, text)
    v = hold(sentence_scores(weights, topic, key), "scores")
    drop(weights)
    w = Window.partitionBy(topic).orderBy(F.round("v", 12).desc(), *order, key)
    best = sent.select(topic, key, text, *order).join(v, [topic, key]).withColumn("r", F.row_number().over(w)).filter("r = 1")
    return best.select(topic, F.col(text).alias("sentence"), F.round("v", 6).alias("score"))

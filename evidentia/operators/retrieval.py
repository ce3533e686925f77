"""Lexical, dense and hybrid retrieval as joins, aggregates and ranked windows.

An index is three tables: ``bags`` (doc, group, terms, tfs, length), of which ``postings`` are the single
terms, ``terms`` (term, df, idf) and ``groups`` (group, n, avgdl). Within groups, the queries' terms are
joined to the postings. A search of all documents scores each where it is read (``best_hits``), as the
matching pairs of queries and documents are too many to be shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from evidentia.functions.text import tokens
from evidentia.operators.best_hits import DIGITS, best_hits, counted
from evidentia.session import durable

# The usual constants of the ranking function and of rank fusion.
K1, B, RRF_K = 1.5, 0.75, 60


#: The 318 English stop words of the usual TF-IDF vectoriser, its oddities kept.
STOP_WORDS = tuple(
    """
    a about above across after afterwards again against all almost alone along already also although always am among amongst amoungst amount an and
    another any anyhow anyone anything anyway anywhere are around as at back be became because become becomes becoming been before beforehand behind being
    below beside besides between beyond bill both bottom but by call can cannot cant co con could couldnt cry de describe detail do done down due during
    each eg eight either eleven else elsewhere empty enough etc even ever every everyone everything everywhere except few fifteen fifty fill find fire
    first five for former formerly forty found four from front full further get give go had has hasnt have he hence her here hereafter hereby herein
    hereupon hers herself him himself his how however hundred i ie if in inc indeed interest into is it its itself keep last latter latterly least less
    ltd made many may me meanwhile might mill mine more moreover most mostly move much must my myself name namely neither never nevertheless next nine no
    nobody none noone nor not nothing now nowhere of off often on once one only onto or other others otherwise our ours ourselves out over own part per
    perhaps please put rather re same see seem seemed seeming seems serious several she should show side since sincere six sixty so some somehow someone
    something sometime sometimes somewhere still such system take ten than that the their them themselves then thence there thereafter thereby therefore
    therein thereupon these they thick thin third this those though three through throughout thru thus to together too top toward towards twelve twenty
    two un under until up upon us very via was we well were what whatever when whence whenever where whereafter whereas whereby wherein whereupon wherever
    whether which while whither who whoever whole whom whose why will with within without would yet you your yours yourself yourselves
    """.split()
)


def vector_terms(text: Column) -> Column:
    """Runs of two letters, numerals and underscores of any alphabet and more, without stop words."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0)), lambda w: ~w.isin(*STOP_WORDS))


class Bm25Index:
    """Of one row for each document. ``min_df`` and ``max_df`` prune terms before lengths are counted; groups share global frequencies."""

    def __init__(self, docs: DataFrame, doc: str, text: str, group: str | None = None, min_df: int = 1, max_df: float = 1.0):
        grouping = F.col(group) if group else F.lit("")
        base = docs.select(F.col(doc).alias("doc"), grouping.alias("grp"), F.lower(text).alias("_t"), tokens(text).alias("words"))
        n = base.agg(F.count(F.lit(1)).alias("n"))
        raw = base.select("doc", "grp", F.explode("words").alias("term")).groupBy("doc", "grp", "term").agg(F.count(F.lit(1)).alias("tf"))
        # Tasks count the documents of a term as they read them, so that no postings are shuffled for this.
        # The blank term, which no text has, carries the number of all words, which a search needs too.
        once = F.transform(F.array_distinct("words"), lambda t: F.struct(t.alias("term"), F.lit(1).cast("bigint").alias("df")))
        total = F.array(F.struct(F.lit("").alias("term"), F.size("words").cast("bigint").alias("df")))
        counts = base.select(F.inline(F.concat(once, total))).groupBy("term").agg(F.sum("df").alias("df"))
        terms = counts.where("term <> ''").crossJoin(F.broadcast(n))  # one row
        if min_df > 1 or max_df < 1.0:
            terms = terms.where((F.col("df") >= min_df) & (F.col("df") <= F.col("n") * max_df))
            raw = raw.join(terms.select("term"), "term", "left_semi")
            listed = raw.groupBy("doc", "grp").agg(F.collect_list(F.struct("term", F.col("tf").cast("int").alias("tf"))).alias("_p"), F.sum("tf").cast("int").alias("dl"))
            bags = base.select("doc", "grp").join(listed, ["doc", "grp"], "left").select("doc", "grp", F.col("_p.term").alias("terms"), F.col("_p.tf").alias("tfs"), F.coalesce("dl", F.lit(0)).alias("dl"))
            self._set(bags, raw, terms)
        else:
            self._set(counted(base), raw, terms)
            self._counts = counts
            self.lengths = base.select("doc", "grp", F.when(F.col("words").isNotNull(), F.size("words")).otherwise(0).alias("dl"))
            self.scanned = base.select("doc", "_t")
        self.docs = base.select("doc", "grp")
        self.terms = terms.select("term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
        self.groups = self.lengths.groupBy("grp").agg(F.count(F.lit(1)).alias("n"), F.avg("dl").alias("avgdl"))

    def _set(self, bags: DataFrame, postings: DataFrame, terms: DataFrame) -> None:
        self.bags, self.postings, self.terms, self._counts = bags, postings, terms, None
        self.docs, self.lengths, self.scanned = bags.select("doc", "grp"), bags.select("doc", "grp", "dl"), bags.select("doc", "terms", "tfs", "dl")

    def save(self, path: str) -> None:
        for name in ("bags", "terms", "groups"):
            getattr(self, name).write.mode("overwrite").parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "Bm25Index":
        index = cls.__new__(cls)
        bags, terms, index.groups = (spark.read.parquet(f"{path}/{name}") for name in ("bags", "terms", "groups"))
        index._set(bags, bags.select("doc", "grp", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf")))), terms)
        return index

    def scores(self, queries: DataFrame, query: str, text: str, group: str | None = None, k1: float = K1, b: float = B) -> DataFrame:
        """``query, doc, grp, score`` of every document with a term in common; one group only where named."""
        asked = self._asked(queries, query, text, *([F.col(group).alias("grp")] if group else [])).join(self.terms, "term")
        hits = self.postings.join(asked, ["term", "grp"] if group else ["term"])
        hits = hits.join(self.lengths, ["doc", "grp"])
        if group:
            hits = hits.join(self.groups.select("grp", "avgdl"), "grp")
        else:
            hits = hits.crossJoin(F.broadcast(self.lengths.agg(F.avg("dl").alias("avgdl"))))  # one row
        longness = 1 - b + b * F.col("dl") / F.greatest("avgdl", F.lit(1e-6))
        part = F.col("idf") * F.col("tf") * (k1 + 1) / F.greatest(F.col("tf") + k1 * longness, F.lit(1e-6)) * F.col("qtf")
        return hits.groupBy("query", "doc", "grp").agg(F.sum(part).alias("score"))

    def _asked(self, queries: DataFrame, query: str, text: str, *by: Column) -> DataFrame:
        """``query, term, qtf`` of each query."""
        words = queries.select(F.col(query).alias("query"), *by, F.explode(tokens(text)).alias("term"))
        return words.groupBy(*words.columns).agg(F.count(F.lit(1)).alias("qtf"))

    def _hits(self, queries: DataFrame, query: str, text: str, k: int, **portions: int) -> DataFrame:
        """``query, doc, score`` with the best ``k`` of each query among them."""
        asked = self._asked(queries, query, text)
        if self._counts is None:
            size = self.lengths.agg(F.count(F.lit(1)).alias("n"), F.sum("dl").alias("words")).first()
            n, words, known = size.n, size.words, durable(asked.join(self.terms, "term"))
        else:  # one reading of the documents counts terms and words
            n = self.docs.count()
            whole = asked.limit(0).unionByName(asked.sparkSession.range(1).select(F.lit(None).alias("query"), F.lit("").alias("term"), F.lit(0).alias("qtf")))
            found = durable(asked.unionByName(whole).join(self._counts, "term"))
            words = found.where("term = ''").agg(F.sum("df")).first()[0]
            known = found.where("term <> ''").withColumn("idf", F.log(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5)))
        return best_hits(self.scanned, known, n, (words or 0) / max(n, 1), k, K1, B, **portions)

    def search(self, queries: DataFrame, query: str, text: str, k: int, group: str | None = None) -> DataFrame:
        """``query, doc, score, rank``: the best ``k``. Within a group, documents without a match
        follow with score 0 while fewer than ``k`` match. Without a positive ``k``, and for unknown
        groups, nothing is found."""
        if k <= 0:
            queries = queries.limit(0)
        if group:
            found = self.scores(queries, query, text, group)
            every = queries.select(F.col(query).alias("query"), F.col(group).alias("grp")).join(self.docs, "grp")
            found = every.join(found.select("query", "doc", "score"), ["query", "doc"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
        else:
            found = self._hits(queries, query, text, max(k, 0))
        return top_k(found, ["query"], "score", "doc", k).select("query", "doc", "score", "rank")

    def overfetched(self, queries: DataFrame, query: str, text: str, k: int, score, passages: DataFrame, doc: str, body: str) -> DataFrame:
        """Search for ``max(25, 5k)``, then the best ``k`` by ``score(passage, query text)``."""
        wide = self.search(queries, query, text, max(25, 5 * k)).select("query", "doc")
        both = wide.join(passages.select(F.col(doc).alias("doc"), F.col(body).alias("_body")), "doc").join(queries.select(F.col(query).alias("query"), F.col(text).alias("_q")), "query")
        return reranked(both, ["query"], F.round(score(F.col("_body"), F.col("_q")), 9), "doc", k).select("query", "doc", "rank")

    def probe(self, queries: DataFrame, query: str, text: str) -> None:
        """Raise before anything costly where the first question finds nothing."""
        if not self.search(queries.orderBy(query).limit(1), query, text, 1).where("score > 0").take(1):
            raise ValueError("the index finds nothing for the first question")

    def summary(self) -> DataFrame:
        """Documents, terms, postings and mean length."""
        d = self.lengths.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("dl").alias("avg_length"), F.countDistinct("grp").alias("n_groups"))
        t = self.terms.agg(F.count(F.lit(1)).alias("n_terms"))
        p = self.postings.agg(F.count(F.lit(1)).alias("n_postings"))
        return d.crossJoin(t).crossJoin(p)  # one row each


def top_k(scored: DataFrame, by: list[str], score: str, tie: str, k: int, digits: int = DIGITS) -> DataFrame:
    """The best k of each partition; equal scores (to ``digits``) go by the tie column."""
    w = Window.partitionBy(*by).orderBy(F.round(score, digits).desc(), F.col(tie))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def cosine(a: Column, b: Column) -> Column:
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return dot / F.nullif(norm(a) * norm(b), F.lit(0.0))


def nearest(vectors: DataFrame, key: str, vector: str, queries: DataFrame, k: int) -> DataFrame:
    """``query, doc, score, rank`` of a stated query set against all vectors. The queries are a
    fixed share of the table and go to every task in blocks of a bounded size."""
    q = queries.select(F.col(key).alias("query"), F.col(vector).alias("_q"))
    block = q.groupBy(F.pmod(F.xxhash64("query"), F.lit(64)).alias("_b")).agg(F.collect_list(F.struct("query", "_q")).alias("_qs"))
    pairs = vectors.select(F.col(key).alias("doc"), F.col(vector).alias("_v")).crossJoin(block)
    scored = pairs.select("doc", "_v", F.inline("_qs")).where(F.col("doc") != F.col("query")).select("query", "doc", cosine(F.col("_q"), F.col("_v")).alias("score"))
    return top_k(scored, ["query"], "score", "doc", k)


def fuse(*ranked: DataFrame, k: int = RRF_K) -> DataFrame:
    """Reciprocal rank fusion of ``query, doc, rank`` tables."""
    rows = ranked[0].select("query", "doc", "rank")
    for other in ranked[1:]:
        rows = rows.unionByName(other.select("query", "doc", "rank"))
    return rows.groupBy("query", "doc").agg(F.sum(1.0 / (k + F.col("rank"))).alias("score"))


def merged_hits(hits: DataFrame, by: list[str], hit: str, turn: str, rank: str) -> DataFrame:
    """Hits over turns, each kept where it first came."""
    w = Window.partitionBy(*by, hit).orderBy(turn, rank)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def reranked(hits: DataFrame, by: list[str], score: Column, tie: str, k: int) -> DataFrame:
    """The best ``k`` by another score; groups of no more than ``k`` hits stay as they are."""
    n = F.count(F.lit(1)).over(Window.partitionBy(*by))
    w = Window.partitionBy(*by).orderBy(F.when(F.col("_n") > k, score).desc(), F.col(tie))
    return hits.withColumn("_n", n).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).drop("_n")


def tfidf_ranking(passages: DataFrame, group: str, doc: str, text: str, questions: DataFrame, question: str, terms=vector_terms) -> DataFrame:
    """Cosine of TF-IDF vectors fitted on each question's own passages and the question:
    smooth idf ``ln((1+n)/(1+df)) + 1``, tokens of ``terms``. A single passage scores 1,
    a passage without a term in common 0."""
    p = passages.select(F.col(group).alias("g"), F.col(doc).cast("string").alias("d"), F.explode(terms(F.col(text))).alias("term"))
    q = questions.select(F.col(group).alias("g"), F.lit("").alias("d"), F.explode(terms(F.col(question))).alias("term"))
    tf = p.unionByName(q).groupBy("g", "d", "term").agg(F.count(F.lit(1)).alias("tf"))
    n_docs = passages.groupBy(F.col(group).alias("g")).agg((F.count(F.lit(1)) + 1).alias("n"))
    df = tf.groupBy("g", "term").agg(F.count(F.lit(1)).alias("df"))
    weight = F.col("tf") * (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1)
    v = tf.join(df, ["g", "term"]).join(n_docs, "g").select("g", "d", "term", weight.alias("w"))
    norms = v.groupBy("g", "d").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    asked = v.where("d = ''").select("g", "term", F.col("w").alias("qw")).join(norms.where("d = ''").select("g", F.col("norm").alias("qn")), "g")
    dots = v.where("d <> ''").join(asked, ["g", "term"]).groupBy("g", "d", "qn").agg(F.sum(F.col("w") * F.col("qw")).alias("dot"))
    scored = dots.join(norms, ["g", "d"]).select("g", "d", (F.col("dot") / (F.col("norm") * F.col("qn"))).alias("score"))
    every = passages.select(F.col(group).alias("g"), F.col(doc).cast("string").alias("d")).join(questions.select(F.col(group).alias("g")), "g").join(n_docs, "g")
    full = every.join(scored, ["g", "d"], "left")
    return full.select(F.col("g").alias(group), F.col("d").alias(doc), F.when(F.col("n") == 2, F.lit(1.0)).otherwise(F.coalesce("score", F.lit(0.0))).alias("score"))


def vector_cosine(a: Column, b: Column) -> Column:
    """Cosine of the TF-IDF vectors of two token arrays, fitted on the pair; 0 without common terms."""
    times = lambda xs, t: F.size(F.filter(xs, lambda x: x == t)).cast("double")
    square = lambda xs, ys: F.aggregate(
        F.array_distinct(xs), F.lit(0.0), lambda s, t: s + F.pow(times(xs, t) * F.when(F.array_contains(ys, t), F.lit(1.0)).otherwise(F.log(F.lit(1.5)) + 1), F.lit(2))
    )
    dot = F.aggregate(F.array_intersect(a, b), F.lit(0.0), lambda s, t: s + times(a, t) * times(b, t))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), dot / F.sqrt(square(a, b) * square(b, a))).otherwise(0.0)


def pair_cosine(rows: DataFrame, key: str, a: str, b: str, terms=vector_terms) -> DataFrame:
    """``key, cosine`` of the TF-IDF vectors of two texts, fitted on the pair; 0 without common terms."""
    side = lambda c, d: rows.select(F.col(key), F.lit(d).alias("d"), F.explode(terms(F.coalesce(F.col(c), F.lit("")))).alias("term"))
    tf = side(a, 0).unionByName(side(b, 1)).groupBy(key, "term").agg(F.count(F.when(F.col("d") == 0, 1)).alias("x"), F.count(F.when(F.col("d") == 1, 1)).alias("y"))
    both = (F.col("x") > 0) & (F.col("y") > 0)
    idf = F.when(both, F.lit(1.0)).otherwise(F.log(F.lit(1.5)) + 1)  # of two texts a term is in one or both
    parts = tf.select(key, (F.col("x") * idf).alias("x"), (F.col("y") * idf).alias("y")).groupBy(key)
    sums = parts.agg(F.sum(F.col("x") * F.col("y")).alias("dot"), F.sum(F.col("x") * F.col("x")).alias("xx"), F.sum(F.col("y") * F.col("y")).alias("yy"))
    scored = sums.select(key, F.when((F.col("xx") > 0) & (F.col("yy") > 0), F.col("dot") / F.sqrt(F.col("xx") * F.col("yy"))).otherwise(0.0).alias("cosine"))
    return rows.select(key).join(scored, key, "left").select(key, F.coalesce("cosine", F.lit(0.0)).alias("cosine"))

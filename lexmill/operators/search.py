"""Inverted index, boolean and phrase matching, BM25, snippets, hybrid ranking and cited answers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import texts as T
from ..functions import urls as U
from ..functions.dialect import SPARK, column
from .merge import first_per, top_per


def build_index(texts: DataFrame, key: str, text: str = "text", stem: bool = False, only: Callable[[Column], Column] | None = None) -> DataFrame:
    """Q1: postings (key, term, tf, positions, doc_len) of texts whose key is unique.

    A row's (term, place) pairs are sorted in the row, and each run of a term becomes one row, so nothing is shuffled.
    With ``stem``, words are stemmed first, in the row. With ``only``, a test of a term, other terms are left out before the sort.
    """
    words = F.expr(_words(text))
    if stem:
        from ..functions.helpers import stemmed_each

        words = stemmed_each(words)
    pairs = F.transform("w", lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    if only is not None:
        pairs = F.filter(pairs, lambda x: only(x["t"]))
    # sort_array compares natively; array_sort calls a lambda for each comparison
    sorted_ = texts.select(key, words.alias("w")).select(key, F.size("w").cast("long").alias("doc_len"), F.sort_array(pairs).alias("p"))
    runs = sorted_.withColumn("b", F.expr("filter(sequence(0, size(p)), k -> k = 0 OR k = size(p) OR p[k].t <> p[k - 1].t)"))
    each = runs.select(key, "doc_len", F.explode(F.expr("CASE WHEN size(p) = 0 THEN array() ELSE transform(sequence(0, size(b) - 2), j -> slice(p, b[j] + 1, b[j + 1] - b[j])) END")).alias("run"))
    return each.select(key, F.expr("run[0].t").alias("term"), F.size("run").cast("long").alias("tf"), F.col("run.i").alias("positions"), "doc_len")


def _words(text: str) -> str:
    return T.words_of(SPARK, text)


def postings_of(texts: DataFrame, key: str, terms: list[str], text: str = "text") -> DataFrame:
    """Postings of a few terms straight from the texts: row-local counts and positions, nothing is exploded but hits."""
    tokens = texts.select(key, F.expr(_words(text)).alias("tokens"))

    def hit(t: str) -> Column:
        return F.struct(F.lit(t).alias("term"), F.filter(F.transform("tokens", lambda x, i: F.when(x == t, i)), lambda i: i.isNotNull()).alias("positions"))

    rows = tokens.select(key, F.size("tokens").cast("long").alias("doc_len"), F.explode(F.array(*map(hit, terms))).alias("x"))
    return rows.select(key, "doc_len", "x.term", F.size("x.positions").cast("long").alias("tf"), "x.positions").where("tf > 0")


def match(postings: DataFrame, key: str, all_: list[str] = (), any_: list[str] = (), none: list[str] = (), phrase: list[str] = (), prefix: str = "") -> DataFrame:
    """Q2: keys by boolean, phrase and prefix conditions, from the postings of the terms concerned."""
    terms = [*all_, *any_, *none, *phrase]
    wanted = F.col("term").isin(terms) if terms else F.lit(False)
    if prefix:
        wanted = wanted | F.col("term").startswith(prefix)
    has = lambda t: F.coalesce(F.bool_or(F.col("term") == t), F.lit(False))
    found = postings.where(wanted).groupBy(key).agg(
        *[has(t).alias(f"_has_{k}") for k, t in enumerate(terms)],
        F.coalesce(F.bool_or(F.col("term").startswith(prefix)), F.lit(False)).alias("_prefix") if prefix else F.lit(True).alias("_prefix"),
        *[F.max(F.when(F.col("term") == t, F.col("positions"))).alias(f"_at_{k}") for k, t in enumerate(phrase)],
    )
    flag = {t: F.col(f"_has_{k}") for k, t in enumerate(terms)}
    test = F.col("_prefix")
    for t in all_:
        test = test & flag[t]
    if any_:
        some = flag[any_[0]]
        for t in any_[1:]:
            some = some | flag[t]
        test = test & some
    for t in none:
        test = test & ~flag[t]
    if phrase:
        at = F.col("_at_0")
        for k in range(1, len(phrase)):
            at = F.array_intersect(at, F.expr(f"transform(_at_{k}, p -> p - {k})"))
        test = test & F.coalesce(F.size(at) > 0, F.lit(False))
    return found.where(test).select(key)


def corpus_size(texts: DataFrame, text: str = "text") -> DataFrame:
    """(docs, avg_len): one row."""
    return texts.agg(F.count("*").alias("docs"), F.avg(F.size(F.expr(_words(text)))).alias("avg_len"))


def bm25(postings: DataFrame, size: DataFrame, key: str, terms: list[str], k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Q3: rank of every key with a term; lower is better (the negated score)."""
    p = postings.where(F.col("term").isin(list(terms)))
    df = p.groupBy("term").agg(F.count("*").alias("df"))
    joined = p.join(F.broadcast(df), "term").crossJoin(F.broadcast(size))  # a row per term, and one row
    idf = F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("doc_len") / F.col("avg_len")))
    return joined.groupBy(key).agg((-F.sum(part)).alias("rank"))


def ranked(texts: DataFrame, terms: list[str], text: str = "text", all_: bool = False, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Q3 with Q2, row by row: the texts with any (or all) of the terms, with their rank among all texts.

    One pass counts documents, lengths and the documents of each term; another scores each text from its own counts. Nothing is shuffled,
    and a row keeps its columns, so that the best are taken without reading the texts again. For terms known beforehand, as in every search here.
    """
    terms = list(dict.fromkeys(terms))
    tokens = texts.withColumn("_w", F.expr(_words(text)))
    stats = tokens.agg(F.count("*").alias("_docs"), F.avg(F.size("_w")).alias("_avg"), F.array(*[F.count_if(F.array_contains("_w", t)) for t in terms]).alias("_df"))
    tf = F.transform(F.array(*map(F.lit, terms)), lambda t: F.size(F.filter("_w", lambda x: x == t)))
    counted = tokens.withColumns({"_tf": tf, "_len": F.size("_w")}).drop("_w").where(F.forall("_tf", lambda x: x > 0) if all_ else F.exists("_tf", lambda x: x > 0))

    def part(x: Column, df: Column) -> Column:
        idf = F.log((F.col("_docs") - df + 0.5) / (df + 0.5) + 1)
        return F.when(x > 0, idf * x * (k1 + 1) / (x + k1 * (1 - b + b * F.col("_len") / F.col("_avg")))).otherwise(0.0)

    score = F.aggregate(F.zip_with("_tf", "_df", part), F.lit(0.0), lambda total, x: total + x)
    return counted.crossJoin(F.broadcast(stats)).withColumn("rank", -score).drop("_tf", "_len", "_docs", "_avg", "_df")  # one row


def snippet(text: str, terms: list[str], n: int = 10, open_: str = "[", close: str = "]", ellipsis: str = " … ") -> Column:
    """Q4: the first window of n space-separated tokens with the most query terms, those marked; else the first 280 characters."""
    listed = F.array(*[F.lit(t) for t in terms])
    tokens = F.split(F.coalesce(F.col(text), F.lit("")), " ")
    bare = lambda t: F.regexp_replace(F.lower(t), r"[^\p{L}\p{N}_]", "")
    # all tokens are made bare at once, as spaces stay
    plain = F.split(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}\p{N}_ ]", ""), " ")
    places = F.filter(F.transform(plain, lambda t, i: F.when(F.array_contains(listed, t), i)), lambda i: i.isNotNull())

    def fragment(at: Column) -> Column:
        """The first of the best windows begins the text or ends at a query term, so only those are counted: at most n terms each."""

        def ending(place: Column, j: Column) -> Column:
            start = F.greatest(place - (n - 1), F.lit(0))
            met = F.filter(F.slice(at, F.greatest(j - (n - 2), F.lit(1)), F.least(j + 1, F.lit(n))), lambda v: v >= start)
            return F.struct(F.size(met).alias("s"), (-start).alias("i"))

        best = F.array_max(F.transform(at, ending))
        start = -best["i"]
        shown = F.transform(F.slice(tokens, start + 1, n), lambda t: F.when(F.array_contains(listed, bare(t)), F.concat(F.lit(open_), t, F.lit(close))).otherwise(t))
        body = F.concat(F.when(start > 0, ellipsis).otherwise(""), F.array_join(shown, " "), F.when(start + n < F.size(tokens), ellipsis).otherwise(""))
        return F.when(best["s"] > 0, body).otherwise(F.substring(F.coalesce(F.col(text), F.lit("")), 1, 280))

    return F.element_at(F.transform(F.array(places), fragment), 1)


def parse_near(rules: str) -> list[tuple[str, str, int]]:
    """'a:b:w,…'; parts that do not fit are ignored."""
    out = []
    for part in rules.split(","):
        bits = part.strip().split(":")
        if len(bits) == 3 and bits[2].strip().isdigit():
            out.append((bits[0].lower(), bits[1].lower(), int(bits[2])))
    return out


def near(df: DataFrame, rules: str, text: str = "text", plain: bool = False) -> DataFrame:
    """Q5: rows for which every rule holds; with ``plain``, words are runs of ASCII letters, digits and apostrophes."""
    words = T.plain_words_of(SPARK, text) if plain else _words(text)
    for a, b, w in parse_near(rules):
        df = df.where(column(T.within_window, words, a=a.replace("'", "\\'"), b=b.replace("'", "\\'"), w=w))
    return df


def dedupe_canonical(hits: DataFrame) -> DataFrame:
    """The best hit (rank, url) of each canonical URL."""
    return first_per(hits.withColumn("canon", column(U.search_canon, "url")), ["canon"], "rank", "url")


def minmax_normalize(df: DataFrame, name: str, out: str, invert: bool = False) -> DataFrame:
    """(x - min) / (max - min), 0 where flat; null and NaN count as the median (of a sketch: within a ten-thousandth of the rows). The bounds are one row, found by partial aggregates."""
    x = F.when(F.isnan(name), None).otherwise(F.col(name))
    bounds = df.agg(F.percentile_approx(x, 0.5).alias("_mid"), F.min(x).alias("_lo"), F.max(x).alias("_hi"))
    v = F.coalesce(x, F.col("_mid"))
    share = F.when(F.col("_hi") > F.col("_lo"), ((F.col("_hi") - v) if invert else (v - F.col("_lo"))) / (F.col("_hi") - F.col("_lo"))).otherwise(0.0)
    return df.crossJoin(F.broadcast(bounds)).withColumn(out, share).drop("_mid", "_lo", "_hi")


def cosine(vector: str, query: list[float]) -> Column:
    q = F.array(*[F.lit(float(v)) for v in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, v: s + v)
    own = F.sqrt(dot(F.col(vector), F.transform(vector, lambda x: x.cast("double"))))
    norm = sum(v * v for v in query) ** 0.5
    return F.when((own == 0) | F.lit(norm == 0), 0.0).otherwise(dot(F.col(vector), q) / (own * norm))


def cosine_topk(vectors: DataFrame, query: list[float], k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Q10."""
    return vectors.select(key, cosine(vector, query).alias("score")).orderBy(F.desc("score"), key).limit(k)


def search_documents(docs: DataFrame, terms: list[str], platform: str = "", jurisdiction: str = "", n: int = 25) -> DataFrame:
    """Q6: all terms, filters, the best of each canonical URL, title and jurisdiction fallbacks, snippet. Ranks are those of the whole index; filters come after."""
    docs = ranked(docs, terms, "clean_text", all_=True)
    if platform:
        wanted = platform.strip().lower().removeprefix("www.").removesuffix(".com")
        docs = docs.where(column(U.norm_platform, U.host_of(SPARK, "url")) == wanted)
    if jurisdiction:
        docs = docs.where(column(U.norm_jurisdiction, "jurisdiction") == jurisdiction.strip().lower())
    best = dedupe_canonical(docs).orderBy("rank", "url").limit(n)
    shown = F.coalesce(F.nullif(snippet("clean_text", terms, 24), F.lit("")), F.nullif("title", F.lit("")), F.col("url"))
    return best.select("id", F.coalesce("doc_type", F.lit("")).alias("doc_type"), "url", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), F.coalesce(F.nullif(F.trim("jurisdiction"), F.lit("")), F.lit("global")).alias("jurisdiction"), shown.alias("snippet"), F.round("rank", 6).alias("rank"))


def search_chunks(chunks: DataFrame, terms: list[str], rules: str = "", n: int = 50) -> DataFrame:
    """Q7: chunks with all terms, ranked over all chunks; those that pass the proximity rules, then the n best; the first 3000 characters."""
    hits = ranked(chunks, terms, all_=True)
    best = (near(hits, rules) if rules else hits).orderBy("rank", "chunk_id").limit(n)
    return best.select("chunk_id", "host", "url", snippet("text", terms, 12).alias("snippet"), F.substring("text", 1, 3000).alias("text"), F.round("rank", 6).alias("rank"))


def hits_by_host(chunks: DataFrame, terms: list[str], cap: int | None = None) -> DataFrame:
    """Q8: hosts of all hits, counted in their rows; with cap, of the cap best hits only."""
    if cap is None:
        hits = chunks.where(F.arrays_overlap(F.expr(_words("text")), F.array(*map(F.lit, terms))))
    else:
        hits = ranked(chunks, terms).orderBy("rank", "chunk_id").limit(cap)
    return hits.groupBy("host").agg(F.count("*").alias("hits"))


def hybrid_rank(chunks: DataFrame, terms: list[str], vectors: DataFrame, query: list[float], alpha: float = 0.55, k: int = 20, fetch_mult: int = 5, rules: str = "") -> DataFrame:
    """Q9: k * fetch_mult hits by rank, proximity, then alpha * text + (1 - alpha) * cosine, both scaled to 0..1. The hits (that many rows) are kept, as their bounds and ranks are asked for more than once; if their executor goes they are computed again."""
    hits = ranked(chunks, terms).orderBy("rank", "chunk_id").limit(k * fetch_mult)
    hits = near(hits, rules) if rules else hits
    similar = vectors.select(F.col("vec_id").alias("_v"), cosine("embedding", query).alias("sim"))
    scored = similar.join(F.broadcast(hits), F.col("vec_key") == F.col("_v"), "right").select("chunk_id", "url", "host", "text", "rank", F.coalesce("sim", F.lit(0.0)).alias("sim")).persist()
    both = minmax_normalize(minmax_normalize(scored, "rank", "text_share", invert=True), "sim", "sim_share")
    final = both.withColumn("score", F.round(alpha * F.col("text_share") + (1 - alpha) * F.col("sim_share"), 6))
    top = final.orderBy(F.desc("score"), "chunk_id").limit(k)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("score"), "chunk_id"))).select("place", "chunk_id", "url", "host", "score", "text")


def answer_sentences(hits: DataFrame, query: str, max_sentences: int = 6, per_host_cap: int = 2) -> DataFrame:
    """Q11: the best sentences of a few hits: (2 * overlap + tf) / log2(10 + tokens), at most per_host_cap of a host, with citation numbers by first use."""
    words = sorted(set(w.lower() for w in query.split()))
    asked = F.array(*[F.lit(w) for w in words])
    tokens = F.expr(_words("sentence"))
    each = hits.select("chunk_id", "host", "url", F.posexplode(column(T.sentences, "text", answers=True)).alias("k", "sentence")).withColumn("_t", tokens)
    tf = F.size(F.filter("_t", lambda t: F.array_contains(asked, t)))
    score = (2 * F.size(F.array_intersect("_t", asked)) + tf) / F.log2(10.0 + F.size("_t"))
    scored = each.withColumn("score", F.round(F.when(F.size("_t") == 0, 0.0).otherwise(score), 6)).where("score > 0").drop("_t")
    taken = top_per(scored, "host", per_host_cap, max_sentences, F.desc("score"), "chunk_id", "k")
    return citation_numbers(taken, F.desc("score"), "chunk_id", "k").select("place", "sentence", "url", "score", "cite")


def citation_numbers(df: DataFrame, *order) -> DataFrame:
    """Rows (few) get a place, and URLs numbers by first appearance."""
    placed = df.withColumn("place", F.row_number().over(Window.orderBy(*order)))
    first = placed.groupBy("url").agg(F.min("place").alias("_first"))
    numbers = first.select("url", F.row_number().over(Window.orderBy("_first")).alias("cite"))
    return placed.join(F.broadcast(numbers), "url")


def synthesize_answer(hits: DataFrame, query: str, max_sentences: int = 6, per_host_cap: int = 2) -> DataFrame:
    """Q11: one row of Markdown."""
    s = answer_sentences(hits, query, max_sentences, per_host_cap)
    bullets = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "sentence", "cite"))), lambda x: F.concat(F.lit("- "), x["sentence"], F.lit(" [^"), x["cite"].cast("string"), F.lit("]"))), "\n")
    sources = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("cite", "url"))), lambda x: F.concat(F.lit("[^"), x["cite"].cast("string"), F.lit("]: "), x["url"])), "\n")
    text = F.concat(F.lit(f"## Answer: {query}\n\n"), F.col("b"), F.lit("\n\n## Sources\n\n"), F.col("s"))
    return s.agg(bullets.alias("b"), sources.alias("s"), F.count("*").alias("n")).select(F.when(F.col("n") == 0, "No high-signal sentences found for this query.").otherwise(text).alias("answer"))

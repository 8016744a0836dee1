"""Quality filter: an interpolated modified Kneser-Ney n-gram model of trusted text.

Every character is a symbol of its own. Tasks count n-grams of trusted rows, Spark sums the counts by
language and n-gram (the shards), and joins of the sharded counts with their contexts, discounts and
continuation counts give the interpolated terms. N-grams of nothing but a language's most frequent
characters, at most ``ALPHABET ** 3``, have their log probabilities in one table per language that is
sent to the tasks; all others, of any number, meet their terms by joins. Both give the same
probabilities, so how many characters the tables hold changes no result. A document is rejected when
its perplexity per character lies outside quantiles that its language's trusted documents set.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetrove.llm.common import drop_tables, keep_table

ORDER = 3
ALPHABET = 96    # symbols of the tables: start, unseen and the most frequent characters
BASE = 1 << 21   # n-grams of all characters are written in this base
LOW, HIGH = 0.002, 0.998
BITS = 25   # of the hashes that tell which rows may be trusted
START = 0   # symbol before a text
UNSEEN = 1  # symbol without counts; what trusted text lacks has the same probability
POOLED = ""  # model of all languages, for languages without trusted text
ROWS = 250  # texts a task reads at a time
HELD = 1 << 20    # n-grams outside the tables a task holds before it passes their counts on
SCALE = 1 << 24   # log probabilities met by joins are summed as whole multiples of 1 / SCALE, in any order the same


def _symbols(text, lut, size):
    """Symbols of a text: below ``size`` those of the tables, from there on the code points of all others."""
    points = np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32)
    symbols = np.concatenate([np.zeros(ORDER - 1, np.int64), lut[points]])
    rare = np.flatnonzero(symbols[ORDER - 1:] == START)
    symbols[rare + ORDER - 1] = points[rare].astype(np.int64) + size
    return symbols


def _codes(symbols, base):
    codes = symbols[:len(symbols) - ORDER + 1]
    for k in range(1, ORDER):
        codes = codes * base + symbols[k:len(symbols) - ORDER + 1 + k]
    return codes


def _split(symbols, size, base):
    """Codes of the n-grams in the tables, in base ``size``, and those of all others, in base ``base``."""
    rare = symbols >= size
    if not rare.any():
        return _codes(symbols, size), symbols[:0]
    n = len(symbols) - ORDER + 1
    far = np.logical_or.reduce([rare[k:n + k] for k in range(ORDER)])
    return _codes(symbols, size)[~far], _codes(symbols, base)[far]


def _rebased(grams, size, base):
    """Codes in base ``base`` of codes in base ``size``."""
    return sum(grams // size ** k % size * base ** k for k in range(ORDER))


def _slices(batches):
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            yield batch.slice(start, ROWS)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids labelled good and not toxic."""
    return labels.filter("quality = 1 AND coalesce(toxic, 0) = 0").select("doc_id").distinct()


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``lang, text`` of all trusted documents.

    Only rows whose id shares a hash of ``BITS`` bits with a trusted one are moved: the hashes are sent to
    every task as bitmaps, at most ``2 ** BITS`` bits however many ids there are. The join that follows is exact.
    """
    ids = trusted_ids(labels)

    def bit(key):
        return F.shiftrightunsigned(F.xxhash64(key), 64 - BITS)
    # The driver and the tasks get a row per bucket of 32,768 bits.
    held = ids.select(F.col("doc_id").try_cast(docs.schema["doc_id"].dataType).alias("id")).filter("id IS NOT NULL")
    maps = held.select(bit("id").alias("bit")).groupBy(
        F.bitmap_bucket_number("bit").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("__bits"))
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    near = rows.withColumn("__bit", bit("doc_id")).withColumn("__bucket", F.bitmap_bucket_number("__bit")).join(F.broadcast(maps), "__bucket")
    place = F.bitmap_bit_position("__bit").cast("int")
    byte = F.conv(F.hex(F.substring("__bits", F.shiftright(place, 3) + 1, F.lit(1))), 16, 10).cast("int")
    hit = F.call_function("shiftright", byte, F.pmod(place, F.lit(8))).bitwiseAND(F.lit(1)) == 1
    # Ids are distinct; a semi join would be moved below the filter.
    return near.filter(hit).select("doc_id", "lang", "text").join(ids.hint("merge"), "doc_id").select("lang", "text")


def alphabets(rows: DataFrame, size=ALPHABET) -> dict[str, list[int]]:
    """Code points of the characters that have a place in tables of ``size`` symbols, per language and pooled.

    These are the most frequent ones, in order. All others are counted and scored too, outside the tables.
    """
    def count(batches):
        total = {}
        for batch in _slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                seen, n = np.unique(np.frombuffer((text or "").encode("utf-32-le", "replace"), np.uint32), return_counts=True)
                for key in {lang or POOLED, POOLED}:
                    sums = total.setdefault(key, {})
                    for p, k in zip(seen.tolist(), n.tolist(), strict=True):
                        sums[p] = sums.get(p, 0) + k
        for key, sums in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([key] * len(sums), pa.string()), pa.array(sums.keys(), pa.int32()),
                                              pa.array(sums.values(), pa.int64())], ["lang", "point", "n"])
    counts = rows.select("lang", "text").mapInArrow(count, "lang STRING, point INT, n BIGINT").groupBy("lang", "point").agg(F.sum("n").alias("n"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "point"))
    found = {POOLED: []}
    for r in counts.withColumn("place", place).filter(F.col("place") <= size - 2).orderBy("lang", "place").collect():
        found.setdefault(r.lang, []).append(r.point)
    return found


def alphabet(rows: DataFrame, size=ALPHABET) -> list[int]:
    """The pooled one of the alphabets."""
    return alphabets(rows, size)[POOLED]


def _lut(points):
    """Symbols in the tables by code point; 0 for other characters. Without an alphabet all are ``UNSEEN``."""
    if points is None:
        return np.full(0x110000, UNSEEN, np.uint8)
    lut = np.zeros(0x110000, np.uint8 if len(points) < 255 else np.int32)
    lut[points] = np.arange(2, len(points) + 2)
    return lut


def _lut_of(points):
    """Function from a language to its table of symbols, made when first asked for."""
    made = {}

    def of(lang):
        key = lang if lang in points else POOLED
        if key not in made:
            made[key] = _lut(points[key])
        return made[key]
    return of


def ngram_counts(rows: DataFrame, points, size=ALPHABET, base=None) -> DataFrame:
    """``lang, gram, n`` summed over all rows; every row also counts for the pooled language.

    ``points`` are the alphabets by language, or one for all. N-grams are written in base ``base``; without
    one in base ``size``, and then the alphabets have to hold all characters.
    """
    points, base = points if isinstance(points, dict) else {POOLED: points}, base or size

    def count(batches):
        lut_of, total, rest, held = _lut_of(points), {}, {}, 0

        def batch_of(key, grams, n):
            return pa.RecordBatch.from_arrays([pa.array([key] * len(grams), pa.string()), pa.array(grams), pa.array(n)], ["lang", "gram", "n"])
        for batch in _slices(batches):
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for key in {lang or POOLED, POOLED}:
                    codes, others = _split(_symbols(text, lut_of(key), size), size, base)
                    grams, n = np.unique(codes, return_counts=True)
                    if key not in total:
                        total[key] = np.zeros(size ** ORDER, np.int64)
                    total[key][grams] += n
                    if len(others) and base == size:
                        raise ValueError("the alphabet lacks characters of the rows")
                    if len(others):
                        rest.setdefault(key, []).append(others)
                        held += len(others)
                if held >= HELD:
                    for other, parts in rest.items():
                        yield batch_of(other, *np.unique(np.concatenate(parts), return_counts=True))
                    rest, held = {}, 0
        for other, parts in rest.items():
            yield batch_of(other, *np.unique(np.concatenate(parts), return_counts=True))
        for key, sums in total.items():
            seen = np.flatnonzero(sums)
            yield batch_of(key, _rebased(seen, size, base), sums[seen])
    counted = rows.mapInArrow(count, "lang STRING, gram BIGINT, n BIGINT")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _terms(counts: DataFrame, order: int, base: int) -> DataFrame:
    """Interpolated modified Kneser-Ney terms of one order: ``lang, order, gram, alpha, gamma``.

    alpha is the discounted share of the n-gram in its context, gamma the weight of the next lower
    order in that context. Discounts come from the counts of counts, per language.
    """
    of = [F.sum((F.col("n") == k).cast("double")).alias(f"n{k}") for k in (1, 2, 3, 4)]
    seen = counts.groupBy("lang").agg(*of)
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))

    def discount(k):
        d = k - (k + 1) * y * F.try_divide(F.col(f"n{k + 1}"), F.col(f"n{k}"))
        plain = F.when(F.col("n1") > 0, y).otherwise(F.lit(0.5))
        return F.when((F.col("n1") > 0) & (F.col(f"n{k}") > 0) & (d > 0) & (d < k), d).otherwise(plain)
    discounts = seen.select("lang", *[discount(k).alias(f"d{k}") for k in (1, 2, 3)])
    context = F.expr(f"gram div {base}").alias("context")
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    cut_rows = counts.join(discounts, "lang").select("lang", "gram", "n", context, cut.alias("cut"))
    totals = cut_rows.groupBy("lang", "context").agg(F.sum("n").alias("total"), F.sum("cut").alias("cuts"))
    return cut_rows.join(totals, ["lang", "context"]).select(
        "lang", F.lit(order).alias("order"), "gram",
        ((F.col("n") - F.col("cut")) / F.col("total")).alias("alpha"), (F.col("cuts") / F.col("total")).alias("gamma"))


def kneser_ney(counts: DataFrame, base=BASE) -> DataFrame:
    """Terms of all orders of n-grams in base ``base``; lower orders count in how many contexts an n-gram was seen."""
    terms, now = None, counts
    for order in range(ORDER, 0, -1):
        part = _terms(now, order, base)
        terms = part if terms is None else terms.unionByName(part)
        shorter = F.pmod("gram", F.lit(base ** (order - 1))).alias("gram")
        now = now.select("lang", shorter).groupBy("lang", "gram").agg(F.count("*").alias("n"))
    return terms


def model_tables(terms: DataFrame, size=ALPHABET, base=None) -> dict[str, np.ndarray]:
    """Log probability of every n-gram of the symbols below ``size``, per language: ``size ** ORDER`` numbers each.

    The base of the interpolation is even over all characters of the language, at least ``size`` symbols.
    """
    base = base or size
    context, own = F.expr(f"gram div {base}"), F.pmod("gram", F.lit(base)) < size
    inside = (F.pmod(context, F.lit(base)) < size) & (F.expr(f"gram div {base} div {base}") < size)
    # What follows such a context outside the table gives one row with the context's weight.
    place = F.when(own, F.col("gram")).otherwise(context * base + UNSEEN).alias("gram")
    held = terms.filter(inside).select("lang", "order", place, F.when(own, F.col("alpha")).otherwise(0.0).alias("alpha"), "gamma")
    rows = held.groupBy("lang", "order", "gram").agg(F.max("alpha").alias("alpha"), F.max("gamma").alias("gamma"), F.count("*").alias("n"))
    tables = {}
    for lang, part in rows.toArrow().to_pandas().groupby("lang"):
        p = np.full(1, 1.0 / max(size, 2 + part["n"][part["order"] == 1].sum()))
        for order in range(1, ORDER + 1):
            of = part[part["order"] == order]
            gram = _rebased(of["gram"].to_numpy(), base, size)
            weight = np.ones(size ** (order - 1))
            weight[gram // size] = of["gamma"]
            # P(c | a b) = alpha(a b c) + gamma(a b) P(c | b)
            lower = np.resize(p.reshape(-1, size) if order > 1 else np.full((1, size), p[0]), (size ** (order - 1), size))
            p = (weight[:, None] * lower).reshape(-1)
            p[gram] += of["alpha"]
        tables[lang] = np.log(np.maximum(p, 1e-300)).astype(np.float32)
    return tables


def log_probabilities(asked: DataFrame, terms: DataFrame, size=ALPHABET, base=BASE) -> DataFrame:
    """``lang, gram, log`` of the distinct ``lang, gram`` asked for: the model by joins, for any n-grams, as exact as the tables."""
    def context(gram):
        return F.call_function("div", gram, F.lit(base))
    first = terms.filter("order = 1").groupBy("lang").agg(F.max("gamma").alias("gamma"), F.greatest(F.count("*") + 2, F.lit(size)).alias("__size"))
    # A row per language.
    found = asked.join(F.broadcast(first.select("lang", (F.col("gamma") / F.col("__size")).alias("p"))), "lang")
    for order in range(1, ORDER + 1):
        of = terms.filter(F.col("order") == order)
        short = F.pmod("gram", F.lit(base ** order)) if order < ORDER else F.col("gram")
        found = found.withColumns({"__short": short, "__context": context(short)})
        if order > 1:
            weights = of.groupBy("lang", context(F.col("gram")).alias("__context")).agg(F.max("gamma").alias("gamma"))
            found = found.join(weights, ["lang", "__context"], "left").withColumn("p", F.col("p") * F.coalesce("gamma", F.lit(1.0)))
        alphas = of.select("lang", F.col("gram").alias("__short"), "alpha")
        found = found.join(alphas, ["lang", "__short"], "left").select("lang", "gram", (F.col("p") + F.coalesce("alpha", F.lit(0.0))).alias("p"))
    return found.select("lang", "gram", F.log(F.greatest("p", F.lit(1e-300))).cast("float").alias("log"))


def train(docs: DataFrame, labels: DataFrame, size=ALPHABET):
    """The model ``(alphabets, tables, terms)``, the first two by language; without trusted text a uniform one."""
    rows = keep_table(training_rows(docs, labels), "trusted")
    points = alphabets(rows, size)
    counts = keep_table(ngram_counts(rows, points, size, BASE), "ngrams")
    drop_tables(rows)
    terms = keep_table(kneser_ney(counts, BASE), "terms")
    drop_tables(counts)
    tables = model_tables(terms, size, BASE)
    if not tables:
        return {POOLED: None}, {POOLED: np.full(size ** ORDER, -np.log(size), np.float32)}, terms
    return points, tables, terms


def _scored(rows: DataFrame, text: str, model, size=ALPHABET, keep_text=True) -> DataFrame:
    """``rows`` with ``__perplexity`` by ``__lang`` and the column ``text``; null for empty and null texts.

    Tasks sum the n-grams of the tables. Rows with others are held with those n-grams, which meet their terms by
    joins: each distinct one once, then by row.
    """
    points, tables, terms = model
    sent = rows.sparkSession.sparkContext.broadcast((points, tables))
    names = [c for c in rows.columns if keep_text or c != text]
    own = {"__key": "string", "__n": "bigint", "__sum": "double", "__grams": "array<bigint>", "__counts": "array<bigint>", "__perplexity": "double"}
    types = [pa.string(), pa.int64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.float64()]

    def score(lang, text, lut_of, tables):
        key = lang if lang in tables else POOLED
        symbols = _symbols(text, lut_of(key), size)
        codes, others = _split(symbols, size, BASE)
        n, total = len(symbols) - ORDER + 1, tables[key][codes].sum(dtype=np.float64)
        grams, counts = np.unique(others, return_counts=True)
        return key, n, float(total), grams, counts, float(np.exp(-total / n)) if n and not len(others) else None

    def run(batches):
        points, tables = sent.value
        lut_of = _lut_of(points)
        for batch in _slices(batches):
            found = [score(g, t, lut_of, tables) for g, t in zip(batch.column("__lang").to_pylist(), batch.column(text).to_pylist(), strict=True)]
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), types, strict=True)] if found else [pa.array([], t) for t in types]
            yield pa.RecordBatch.from_arrays([*batch.select(names).columns, *columns], [*names, *own])
    schema = rows.select(*[F.col(f"`{c}`") for c in names], *[F.lit(None).cast(t).alias(c) for c, t in own.items()]).schema
    kept = keep_table(rows.mapInArrow(run, schema).withColumn("__row", F.monotonically_increasing_id()), "scored")
    far = kept.filter("cardinality(__grams) > 0")
    grams = far.select("__row", F.col("__key").alias("lang"), F.explode(F.arrays_zip("__grams", "__counts")).alias("__pair")).select(
        "__row", "lang", F.col("__pair.__grams").alias("gram"), F.col("__pair.__counts").alias("n"))
    logs = keep_table(log_probabilities(grams.select("lang", "gram").distinct(), terms, size), "logs")
    part = F.col("n") * F.round(F.col("log").cast("double") * SCALE).cast("bigint")
    sums = keep_table(grams.join(logs, ["lang", "gram"]).groupBy("__row").agg(F.sum(part).alias("__rest")), "sums")
    drop_tables(logs)
    spent = ["__row", "__key", "__n", "__sum", "__grams", "__counts"]
    whole = -(F.col("__sum") + F.col("__rest") / SCALE) / F.col("__n")
    joined = far.join(sums, "__row").withColumn("__perplexity", F.exp(whole)).drop("__rest", *spent)
    return kept.filter("cardinality(__grams) = 0").drop(*spent).unionByName(joined)


def perplexities(docs: DataFrame, model, size=ALPHABET) -> DataFrame:
    """``doc_id, lang, perplexity`` of every row; null for empty and null texts."""
    rows = docs.select("doc_id", F.col("lang").cast("string").alias("__lang"), F.col("text").alias("__text"))
    found = _scored(rows, "__text", model, size, keep_text=False)
    return found.withColumnsRenamed({"__lang": "lang", "__perplexity": "perplexity"})


def limits(scored: DataFrame, labels: DataFrame, low=LOW, high=HIGH) -> DataFrame:
    """``lang, low, high``: quantiles of all trusted documents' perplexity, per language and pooled."""
    good = scored.filter("perplexity IS NOT NULL").join(trusted_ids(labels), "doc_id", "left_semi")
    cuts = F.percentile_approx("perplexity", [low, high], 100_000).alias("cuts")
    by_lang = good.filter(F.col("lang") != POOLED).groupBy("lang").agg(cuts)
    pooled = good.groupBy().agg(cuts).select(F.lit(POOLED).alias("lang"), "cuts")
    return by_lang.unionByName(pooled).select("lang", F.get("cuts", F.lit(0)).alias("low"), F.get("cuts", F.lit(1)).alias("high"))


def _judged(scored: DataFrame, found: DataFrame) -> DataFrame:
    """``scored`` with ``__low, __high, __kept`` by ``__lang`` and ``__perplexity``."""
    own = F.broadcast(found.filter(F.col("lang") != POOLED).select(F.col("lang").alias("__of"), F.col("low").alias("__own_low"), F.col("high").alias("__own_high")))
    pooled = F.broadcast(found.filter(F.col("lang") == POOLED).select(F.col("low").alias("__all_low"), F.col("high").alias("__all_high")))
    joined = scored.join(own, F.col("__lang") == F.col("__of"), "left").join(pooled, F.lit(True), "left")
    out = joined.withColumns({"__low": F.coalesce("__own_low", "__all_low", F.lit(0.0)),
                              "__high": F.coalesce("__own_high", "__all_high", F.lit(float("inf")))})
    kept = F.coalesce(F.col("__perplexity").between(F.col("__low"), F.col("__high")), F.lit(False))
    return out.withColumn("__kept", kept).drop("__of", "__own_low", "__own_high", "__all_low", "__all_high")


def quality_report(docs: DataFrame, labels: DataFrame, low=LOW, high=HIGH) -> DataFrame:
    """``doc_id, lang, perplexity, low, high, kept`` per document.

    Empty and null texts have no perplexity and are not kept. Languages without trusted documents,
    null and empty included, use the pooled model and limits; without any trusted document nothing but empty
    text is rejected. Repeated rows are rows of their own; an empty table gives no rows.
    """
    model = train(docs, labels)
    scored = perplexities(docs, model)
    drop_tables(model[2])
    found = keep_table(limits(scored, labels, low, high), "limits")
    out = _judged(scored.withColumnsRenamed({"lang": "__lang", "perplexity": "__perplexity"}), found)
    return out.select("doc_id", *[F.col(f"__{c}").alias(c) for c in ("lang", "perplexity", "low", "high", "kept")])


def keep_good(docs: DataFrame, labels: DataFrame, low=LOW, high=HIGH) -> DataFrame:
    """``docs`` without the rejected rows, columns unchanged. Rows are scored once and written with their score."""
    model = train(docs, labels)
    text = "text" if "text" in docs.columns else "__text"  # the column itself: a second one would double what a task holds
    rows = docs.withColumns({"__lang": F.col("lang").cast("string")} | ({} if text in docs.columns else {text: F.col("text")}))
    scored = _scored(rows, text, model, keep_text=text in docs.columns)
    drop_tables(model[2])
    found = limits(scored.select("doc_id", F.col("__lang").alias("lang"), F.col("__perplexity").alias("perplexity")), labels, low, high)
    judged = _judged(scored, keep_table(found, "limits")).drop("__lang", "__perplexity", "__low", "__high")
    return judged.filter("__kept").drop("__kept")

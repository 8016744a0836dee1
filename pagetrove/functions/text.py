"""Text, tag, file-name and date expressions (native)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------
ILLEGAL_NAME_CHARS = r'[<>:"/\\|?*\x00-\x1f]'
TRAILING_PUNCT = r"[ ,;:\-–—(\[{._]+$"
MAX_NAME_BYTES = 200
MAX_RELATIVE_PATH = 200
MAX_EPOCH = 253402300800  # end of year 9999
SUFFIX_ROOM = 6  # "-99" and ".md"
LINE_BREAKS = "\\r\\n|[\\n\\r\\x0B\\x0C\\x1C-\\x1E\\x85\\u2028\\u2029]"
# ----------------------------------------------------------------------------------------------


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once, also when lambdas inside refer to it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """Unicode-aware trim at both ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def blank_to_null(x: Column) -> Column:
    return F.when(strip(x) != "", x)


def lines(x: Column) -> Column:
    """Split on every line boundary; a break at the end adds no empty line."""
    return let(F.split(x, LINE_BREAKS, -1), lambda parts: F.when(
        F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts))


def slug(x: Column, max_len=None, default=None) -> Column:
    s = F.regexp_replace(F.lower(x), r"(?U)[^\w\s-]", "")
    s = F.regexp_replace(F.regexp_replace(s, r"(?U)[\s_]+", "-"), r"^-+|-+$", "")
    if max_len is not None:
        s = F.substring(s, 1, max_len)
    return s if default is None else F.coalesce(F.nullif(s, F.lit("")), F.lit(default))


def tag_slug(x: Column) -> Column:
    return slug(x)


def media_slug(x: Column) -> Column:
    return slug(x, 40, "media")


def file_slug(x: Column) -> Column:
    return slug(x, 60, "untitled")


def clean_tags(tags: Column) -> Column:
    """Lower-case, no leading ``#``, blanks dropped, first of equal tags kept."""
    norm = F.transform(tags, lambda t: F.lower(F.regexp_replace(strip(t), r"^#+", "")))
    return F.array_distinct(F.filter(norm, lambda t: t.isNotNull() & (t != "")))


def tag_key(tag: Column) -> Column:
    return F.regexp_replace(F.lower(tag), r"[^a-z0-9]", "")


def parse_tag_input(raw: Column) -> Column:
    """Typed tag text to struct(to_add, skipped): ``-tag`` tokens are reported, not applied."""
    tokens = F.filter(F.split(F.coalesce(raw, F.lit("")), r"(?U)[,\s]+"), lambda t: t != "")
    add = F.filter(tokens, lambda t: ~t.startswith("-"))
    add = F.transform(add, lambda t: F.lower(strip(F.regexp_replace(t, r"^[+#]+", ""))))
    return F.struct(
        F.array_distinct(F.filter(add, lambda t: t != "")).alias("to_add"),
        F.filter(tokens, lambda t: t.startswith("-")).alias("skipped"))


def swap_tag(tags: Column, old: Column, new: Column) -> Column:
    return clean_tags(F.transform(tags, lambda t: F.when(t == old, new).otherwise(t)))


def clean_folder(raw: Column) -> Column:
    s = F.replace(F.coalesce(raw, F.lit("")), F.lit("\\"), F.lit("/"))
    return F.upper(F.regexp_replace(strip(s), r"^/+|/+$", ""))


def _drop_last_word(s: Column) -> Column:
    return F.when(s.contains(" "), F.regexp_extract(s, r"(?s)^(.*) [^ ]*$", 1)).otherwise(s)


def _cut_bytes(s: Column, limit: int) -> Column:
    # A cut inside a character leaves an invalid tail, which decodes to replacement characters.
    cut = F.make_valid_utf8(F.substring(F.encode(s, "UTF-8"), 1, limit).cast("string"))
    return F.regexp_replace(cut, "�+$", "")


def safe_filename(name: Column, max_chars=150) -> Column:
    """Readable file name: illegal characters dropped, cut on a word, at most 200 UTF-8 bytes."""
    limit = max_chars if isinstance(max_chars, Column) else F.lit(max_chars)
    s = strip(F.regexp_replace(F.regexp_replace(name, ILLEGAL_NAME_CHARS, ""), r"(?U)\s+", " "))
    s = F.when(F.char_length(s) > limit, _drop_last_word(F.substring(s, F.lit(1), limit))).otherwise(s)
    s = F.when(F.octet_length(s) > MAX_NAME_BYTES,
               _drop_last_word(_cut_bytes(s, MAX_NAME_BYTES))).otherwise(s)
    return F.coalesce(F.nullif(F.regexp_replace(s, TRAILING_PUNCT, ""), F.lit("")),
                      F.lit("untitled"))


def name_budget(folder: Column) -> Column:
    room = F.lit(MAX_RELATIVE_PATH - 1 - SUFFIX_ROOM) - F.char_length(folder)
    return F.greatest(F.lit(16), F.least(F.lit(150), room))


def relative_folder(folder: Column) -> Column:
    return F.regexp_replace(strip(F.coalesce(folder, F.lit(""))), r"^[/\\]+", "")


def escapes_root(path: Column) -> Column:
    """True when ``..`` parts climb above the root at any point of the path."""
    parts = F.split(relative_folder(path), "/")
    step = F.aggregate(
        parts, F.struct(F.lit(0).alias("depth"), F.lit(False).alias("out")),
        lambda acc, p: F.struct(
            F.when(p == "..", acc["depth"] - 1).when(p.isin("", "."), acc["depth"])
             .otherwise(acc["depth"] + 1).alias("depth"),
            (acc["out"] | ((p == "..") & (acc["depth"] < 1))).alias("out")))
    return step["out"]


def posted_date(value: Column) -> Column:
    """``YYYYMMDD`` text as a date, else epoch seconds (UTC), else the text itself."""
    s = value.cast("string")
    by_text = F.when(s.rlike(r"^[0-9]{8}$"), F.date_format(F.try_to_date(s, "yyyyMMdd"), "yyyy-MM-dd"))
    epoch = s.try_cast("double")
    by_epoch = F.when(F.abs(epoch) < MAX_EPOCH, F.date_format(F.timestamp_seconds(epoch), "yyyy-MM-dd"))
    return F.coalesce(by_text, by_epoch, s, F.lit(""))


def yyyymmdd(epoch: Column) -> Column:
    ts = epoch.try_cast("bigint")
    return F.when(F.abs(ts) < MAX_EPOCH, F.date_format(F.timestamp_seconds(ts), "yyyyMMdd"))


def clock(seconds: Column) -> Column:
    """Seconds as ``m:ss``, or ``h:mm:ss`` from an hour up."""
    s = seconds.cast("bigint")
    h, m, sec = F.floor(s / 3600), F.floor((s % 3600) / 60), s % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    return F.when(h > 0, F.concat_ws(":", h.cast("string"), two(m), two(sec))) \
            .otherwise(F.concat_ws(":", m.cast("string"), two(sec)))


def yaml_safe(x: Column) -> Column:
    """One-line text for a double-quoted header value."""
    return F.replace(strip(F.regexp_replace(x, r"[\r\n\t]+", " ")), F.lit('"'), F.lit("'"))


def source_link(value: Column) -> Column:
    from pagetrove.functions.urls import netloc
    s = strip(value)
    return F.when(s.rlike("^https?://"), F.concat(
        F.lit("["), F.coalesce(F.nullif(netloc(s), F.lit("")), s), F.lit("]("), s, F.lit(")"))).otherwise(s)


def host_link(url: Column) -> Column:
    from pagetrove.functions.urls import domain
    return F.concat(F.lit("["), F.coalesce(F.nullif(domain(url), F.lit("")), url), F.lit("]("), url,
                    F.lit(")"))


def humanise(value: Column) -> Column:
    s = F.initcap(strip(F.regexp_replace(value, "[_-]", " ")))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("Flag"))


def paragraphs(text: Column, per=4) -> Column:
    """Whitespace-folded text cut after sentence ends, ``per`` sentences to a paragraph."""
    flat = strip(F.regexp_replace(text, r"(?U)\s+", " "))

    def group(sents):
        n = F.ceil(F.size(sents) / per).cast("int")
        return F.when(n == 0, F.array().cast("array<string>")).otherwise(F.transform(
            F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
            lambda i: F.array_join(F.slice(sents, i * per + 1, F.lit(per)), " ")))
    return let(F.filter(F.split(flat, r"(?<=[.!?])\s+"), lambda s: s != ""), group)


def drop_repeats(arr: Column) -> Column:
    """Remove elements equal to the one right before them."""
    return let(arr, lambda a: F.filter(a, lambda x, i: (i == 0) | ~x.eqNullSafe(F.get(a, i - 1))))


def vtt_text(raw: Column) -> Column:
    body = F.filter(lines(raw), lambda x: ~(
        (strip(x) == "") | x.startswith("WEBVTT") | x.rlike(r"(?U)^\d{2}:\d{2}")
        | x.rlike(r"(?U)^[A-Za-z\-]+:\s")))
    plain = F.filter(F.transform(body, lambda x: strip(F.regexp_replace(x, r"<[^>]+>", ""))),
                     lambda x: x != "")
    return F.array_join(drop_repeats(plain), " ")


def srt_text(raw: Column) -> Column:
    body = F.filter(lines(raw), lambda x: ~(
        strip(x).rlike(r"(?U)^\d+$") | x.rlike(r"(?U)^\d{2}:\d{2}:\d{2}") | (strip(x) == "")))
    return F.array_join(F.transform(body, strip), " ")


def hashtags(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)#(\w+)"), 1)


def caption_from_lines(contents: Column) -> Column:
    """Caption text from its authored lines; null unless it is a real multi-line caption."""
    raw = F.transform(contents, lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"(?U)\s+$", ""))

    def assemble(filled):
        first, last = F.get(filled, F.lit(0)), F.get(filled, F.size(filled) - 1)
        text = F.array_join(F.slice(raw, first, last - first + 1), "\n")
        return F.when((F.size(contents) >= 2) & (F.size(filled) >= 2) & (F.char_length(text) >= 30), text)
    return let(F.filter(F.transform(raw, lambda x, i: F.when(x != "", i + 1)),
                        lambda i: i.isNotNull()), assemble)


def restore_breaks(text: Column) -> Column:
    """Line breaks of a flattened caption: no-break spaces, space runs, dash bullets."""
    s = F.regexp_replace(text, "[ \\t]*\\u00A0[ \\t\\u00A0]*", "\n")
    s = F.regexp_replace(s, " {2,}", "\n")
    bullet = r"(?U)(?<=\S) -(?=[^\s-])"
    s = F.when(F.regexp_count(s, F.lit(bullet)) >= 3, F.regexp_replace(s, bullet, "\n-")).otherwise(s)
    out = F.array_join(F.filter(F.transform(F.split(s, "\n"), strip), lambda x: x != ""), "\n")
    return F.when(text.isNull(), F.lit("")).when(text.contains("\n"), text) \
            .otherwise(F.coalesce(F.nullif(out, F.lit("")), text))


def safe_handle(value: Column) -> Column:
    h = F.regexp_replace(strip(F.coalesce(value, F.lit(""))), r"^@+", "")
    bad = (F.lower(h) == "unknown") | h.rlike(r"(?U)\s") | h.rlike(r"(?U)^\d+$")
    return F.when(bad, F.lit("")).otherwise(h)


def author_from_description(desc: Column) -> Column:
    return F.nullif(strip(F.regexp_extract(desc, r"^\s*([A-Za-z0-9_.\- ]{2,40}?)'s\b", 1)), F.lit(""))


def failure_status(message: Column) -> Column:
    def has(*needles):
        return F.array_contains(F.array(*[message.contains(n) for n in needles]), True)
    return F.when(has("404", "not found", "removed"), "failed_permanent") \
            .when(has("401", "403", "private", "login"), "retry_after_auth").otherwise("failed")

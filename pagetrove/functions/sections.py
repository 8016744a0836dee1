"""Note sections as Column expressions over one wide note row (see operators.rendering)."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrove.functions import markdown as M
from pagetrove.functions import text as X
from pagetrove.functions import urls as U
from pagetrove.functions.units import annotate
from pagetrove.operators import recipes as R

RULE = "---"


def _c(name):
    return F.col(name)


def _has(c):
    return F.coalesce(c, F.lit("")) != ""


def _when(cond, *parts):
    return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])).otherwise("")


def _line(cond, *parts):
    return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _lines(*parts):
    return F.concat_ws("\n", *parts)


def commas(n: Column) -> Column:
    return F.format_number(n.cast("bigint"), 0)


def summary() -> Column:
    return _when(_has(_c("summary")), "> [!abstract] Summary\n> ", _c("summary"), "\n")


def takeaways() -> Column:
    items = F.array_join(F.transform("key_takeaways", lambda t: F.concat(F.lit("> - "), t)), "\n")
    return _when(F.size("key_takeaways") > 0, "> [!tip] Key Takeaways\n", items, "\n")


def translation() -> Column:
    lang = X.strip(F.coalesce(_c("source_language"), F.lit("")))
    suffix = _when((lang != "") & (F.lower(lang) != "english"), " (from ", lang, ")")
    body = X.strip(F.coalesce(_c("translation"), F.lit("")))
    return _when(body != "", "> [!info]+ 🌐 English Translation", suffix, "\n", M.quoted(body), "\n")


def _handle():
    return X.safe_handle(F.coalesce(F.nullif(_c("metadata.author_handle"), F.lit("")), _c("author")))


def _after_slash(author):
    return F.regexp_extract(author, r"([^/]*)$", 1)


def author_link() -> Column:
    a, h = _c("author"), _handle()
    link = lambda base, x: F.concat(F.lit("["), a, F.lit("](" + base), x, F.lit(")"))
    p = _c("platform")
    return F.when(~_has(a), "").when(p == "reddit", link("https://reddit.com/u/", _after_slash(a))) \
        .when((p == "youtube") & _has(_c("metadata.channel_id")), link("https://youtube.com/channel/", _c("metadata.channel_id"))) \
        .when((p == "instagram") & (h != ""), link("https://instagram.com/", h)) \
        .when((p == "tiktok") & (h != ""), link("https://tiktok.com/@", h)).otherwise(a)


def _raw_date(first="upload_date"):
    up, ep = F.nullif(_c("metadata.upload_date"), F.lit("")), _c("metadata.created_utc")
    epoch = F.when(ep != 0, F.format_string("%.0f", F.floor(ep).cast("double")))
    return F.coalesce(up, epoch) if first == "upload_date" else epoch


def posted() -> Column:
    raw = _raw_date()
    return F.when(raw.isNotNull(), X.posted_date(raw))


def _channel_link(prefix="youtube"):
    ch, cid = _c(f"{prefix}.channel"), _c(f"{prefix}.channel_id")
    return F.when(_has(cid), F.concat(F.lit("["), ch, F.lit("](https://youtube.com/channel/"), cid, F.lit(")"))).otherwise(ch)


def metadata(run_date: Column) -> Column:
    m, y = (lambda n: _c(f"metadata.{n}")), (lambda n: _c(f"youtube.{n}"))
    author = author_link()
    video = _has(y("url"))
    stats = F.concat_ws(" · ", F.concat(commas(y("views")), F.lit(" views")), F.concat(commas(y("likes")), F.lit(" likes")),
                        F.when(y("duration") > 0, X.clock(y("duration"))))
    src = F.coalesce(F.nullif(_c("followed_url"), F.lit("")), F.nullif(_c("hint"), F.lit("")))
    host = F.coalesce(F.nullif(U.domain(src), F.lit("")), F.lit("source"))
    return F.concat(F.lit("> [!info]- Sources & Metadata\n"), _lines(
        F.concat(F.lit("> - **Platform:** "), _c("platform")),
        _line(author != "", "> - **Author:** ", author),
        _line(_has(m("subreddit")), "> - **Subreddit:** [r/", m("subreddit"), "](https://reddit.com/r/", m("subreddit"), ")"),
        _line(posted().isNotNull(), "> - **Posted:** ", posted()),
        _line(m("view_count") != 0, "> - **Views:** ", commas(m("view_count"))),
        _line(m("score") != 0, "> - **Score:** ", commas(m("score"))),
        _line(video, "> - **Video:** [YouTube](", y("url"), ")"),
        _line(video & _has(y("channel")), "> - **YouTube Channel:** ", _channel_link()),
        _line(video & _has(y("upload_date")), "> - **YouTube Posted:** ", X.posted_date(y("upload_date"))),
        _line(video & (stats != ""), "> - **YouTube Stats:** ", stats),
        _line(src.isNotNull(), F.when(_has(_c("followed_url")), "> - **Recipe source:** [").otherwise("> - **Recipe likely at:** ["),
              host, "](", src, ")"),
        F.concat(F.lit("> - **Saved:** "), run_date)), F.lit("\n"))


def embeds(paths: Column) -> Column:
    return _when(F.size(paths) > 0, F.array_join(F.transform(paths, M.embed_block), "\n\n"), "\n")


def no_media() -> Column:
    return _when(F.coalesce(F.size("media_paths"), F.lit(0)) <= 0, "> [!warning] Media file unavailable\n")


def photos() -> Column:
    """Photos embedded in the article body, without the hero; a note shows twelve."""
    paths = M.embed_paths(_c("article_markdown"), F.slice(_c("media_paths"), 1, 1))
    return X.let(paths, lambda ps: _when(F.size(ps) > 0, "## 📸 Photos\n\n", embeds(ps)))


def transcript(collapse=True) -> Column:
    paras = X.paragraphs(_c("transcript"))
    if collapse:
        return _when(_has(_c("transcript")), "> [!note]- Full Transcript\n> ", F.array_join(paras, "\n>\n> "), "\n")
    return _when(_has(_c("transcript")), "## Full Transcript\n\n", F.array_join(paras, "\n\n"), "\n")


def body_quote() -> Column:
    score = _c("metadata.score")
    return _when(_has(_c("body_text")), "> [!quote] Original Post\n> **", _c("platform"), " — ",
                 F.coalesce(F.nullif(_c("author"), F.lit("")), F.lit("Unknown")), "**",
                 _when(score != 0, " — ", commas(score), " upvotes"), "\n>\n",
                 M.quoted(_c("body_text")), "\n")


def caption(text: Column = None) -> Column:
    text = _c("body_text") if text is None else text
    return _when(_has(text), "> [!quote] Caption\n", M.quoted(text), "\n")


def reel_caption() -> Column:
    return caption(F.coalesce(F.nullif(_c("body_text"), F.lit("")), _c("captions")))


def _comment(c, depth):
    prefix = F.repeat(F.lit("> "), depth)
    who = F.coalesce(c["author"], F.lit("[deleted]"))
    name = F.when(_has(c["permalink"]), F.concat(F.lit("[u/"), who, F.lit("]("), c["permalink"], F.lit(")"))).otherwise(
        F.concat(F.lit("u/"), who))
    head = F.concat(prefix, F.lit("**"), name, F.lit("**"), F.when(c["is_op"], ' <span class="op-badge">OP</span>').otherwise(""),
                    F.lit(" ("), F.coalesce(c["score"], F.lit(0)).cast("string"), F.lit(" ↑)"))
    body = F.coalesce(c["text"], F.lit(""))
    text = F.array_join(F.transform(X.lines(body), lambda ln: F.concat(prefix, ln)), "\n")
    return F.when(body == "", head).otherwise(F.concat(head, F.lit("\n"), text))


def comments() -> Column:
    """Comments as nested quotes; a reply of the author sits under its ancestors."""
    def block(c):
        above = F.transform(c["thread_context"], lambda a, i: _comment(a, i + 1))
        deep = _comment(c, F.greatest(F.coalesce(F.size(c["thread_context"]), F.lit(0)), F.lit(0)) + 1)
        return F.concat_ws("\n", F.array_join(F.when(F.size(above) > 0, above), "\n"), deep)
    return _when(F.size("top_comments") > 0, "> [!example]- Top Comments\n",
                 F.array_join(F.transform("top_comments", block), "\n>\n"), "\n")


def video_description() -> Column:
    d = _c("youtube.description")
    return _when(_has(d), "> [!quote]- Video Description (from ", F.coalesce(F.nullif(_c("youtube.channel"), F.lit("")), F.lit("YouTube")),
                 " on YouTube)\n", M.quoted(d), "\n")


def paywall() -> Column:
    return _when(F.coalesce(_c("possible_paywall"), F.lit(False)), "> [!warning] Content may be paywalled — text extraction may be incomplete\n")


def video_embed() -> Column:
    url = F.coalesce(F.nullif(_c("metadata.canonical_url"), F.lit("")), _c("url"))
    return F.concat(F.lit("!["), F.coalesce(_c("title"), F.lit("")), F.lit("]("), url, F.lit(")\n"))


def chapters() -> Column:
    vid = F.coalesce(F.nullif(_c("metadata.video_id"), F.lit("")), F.nullif(_c("youtube.video_id"), F.lit("")))
    base = F.coalesce(F.nullif(_c("youtube.url"), F.lit("")), _c("url"))

    def one(ch):
        link = F.coalesce(F.concat(F.lit("https://youtube.com/watch?v="), vid, F.lit("&t="), ch["seconds"].cast("string")), base)
        return F.concat(F.lit("> - [**"), ch["time_str"], F.lit("**]("), link, F.lit(") "), ch["title"])
    return _when(F.size("chapters") > 0, "> [!abstract]- Chapters\n", F.array_join(F.transform("chapters", one), "\n"), "\n")


def article_body() -> Column:
    md = X.strip(F.coalesce(_c("article_markdown"), F.lit("")))
    return F.when(md != "", F.concat(md, F.lit("\n"))).otherwise(body_quote())


def travel_details() -> Column:
    return F.lit("## Key Details\n*(costs, tips, and logistics from original content)*\n")


def image_text() -> Column:
    t = X.strip(F.coalesce(_c("image_text"), F.lit("")))
    return _when(t != "", "> [!quote] Text from Images\n", M.quoted(t), "\n")


# ---- recipe ----------------------------------------------------------------------------------

def _groups(groups, flat, line):
    """Groups under bold titles, else the flat list; ``line(item, index in its list)``."""
    def block(g):
        name = F.regexp_replace(X.strip(F.coalesce(g["name"], F.lit(""))), ":+$", "")
        text = F.array_join(F.transform(g["items"], line), "\n")
        return F.when(name != "", F.concat(F.lit("**"), name, F.lit("**\n\n"), text)).otherwise(text)
    filled = F.filter(groups, lambda g: F.size(g["items"]) > 0)
    one = F.array(F.struct(F.lit(None).cast("string").alias("name"), flat.alias("items")))
    every = F.when(F.size(filled) > 0, filled).when(F.size(flat) > 0, one)
    return F.coalesce(F.array_join(F.transform(every, block), "\n\n"), F.lit(""))


def ingredient_lines() -> Column:
    """Ingredients with measurements annotated and their matched icon in front."""
    groups, flat = _c("recipe_ingredient_groups"), _c("recipe_ingredients")
    every = F.when(F.size(F.filter(groups, lambda g: F.size(g["items"]) > 0)) > 0,
                   F.flatten(F.transform(groups, lambda g: g["items"]))).otherwise(flat)
    icons = F.when(F.size("ingredient_icons") > 0, F.map_from_entries(F.transform(
        F.arrays_zip(F.array_distinct(every).alias("item"), R.match_icons(F.array_distinct(every), _c("ingredient_icons")).alias("icon")),
        lambda z: F.struct(z["item"], z["icon"]))))
    return X.let(icons, lambda found: _groups(groups, flat, lambda i: F.concat(
        F.lit("- "), F.coalesce(F.concat(F.lit("![|24]("), F.try_element_at(found, i), F.lit(") ")), F.lit("")), annotate(i))))


def method_lines() -> Column:
    return _groups(_c("recipe_instruction_groups"), _c("recipe_instructions"),
                   lambda s, i: F.concat((i + 1).cast("string"), F.lit(". "), annotate(s)))


def has_recipe() -> Column:
    n = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    return n("recipe_ingredients") | n("recipe_instructions") | n("recipe_ingredient_groups")


def recipe() -> Column:
    meta = F.concat_ws(" · ", X.blank_to_null(_c("recipe_servings")), X.blank_to_null(_c("recipe_time")))
    notes = X.strip(F.coalesce(_c("recipe_notes"), F.lit("")))
    part = lambda title, text: X.let(text, lambda t: F.when(t != "", F.concat(F.lit(title), t)))
    inner = F.concat_ws("\n\n", F.when(meta != "", F.concat(F.lit("*"), meta, F.lit("*"))),
                        part("**🧺 Ingredients**\n\n", ingredient_lines()), part("**🍳 Method**\n\n", method_lines()),
                        part("**📝 Notes**\n\n", annotate(notes)))
    box = X.let(inner, lambda t: F.when(t != "", F.concat(F.lit("> [!example]+ 🍽️ Recipe\n"), M.quoted_block(t), F.lit("\n"))).otherwise(
        "> [!example]+ 🍽️ Recipe\n> *(Ingredients and instructions — see sources below)*\n"))
    panel = R.nutrition_panel(_c("nutrition"), F.coalesce(F.size("source_keys") > 0, F.lit(False)))
    return F.concat(box, X.let(panel, lambda p: F.when(F.coalesce(p, F.lit("")) != "", F.concat(F.lit("\n"), p, F.lit("\n"))).otherwise("")))


def recipe_page_caption() -> Column:
    flat = lambda g: F.flatten(F.transform(g, lambda x: F.concat(x["items"], F.array(F.coalesce(x["name"], F.lit(""))))))
    words = F.concat_ws(" ", _c("recipe_ingredients"), _c("recipe_instructions"), flat(_c("recipe_ingredient_groups")),
                        flat(_c("recipe_instruction_groups")), _c("recipe_notes"))
    return F.when(R.caption_is_redundant(_c("body_text"), words), "").otherwise(caption())


# ---- checks ----------------------------------------------------------------------------------

def _warned():
    fc = _c("check")
    return (F.coalesce(F.size(fc["disputed_claims"]), F.lit(0)) > 0) | F.coalesce(
        F.exists(fc["flags"], lambda f: F.coalesce(f["severity"], F.lit("")) == "warning"), F.lit(False))


def _source_line(x):
    return F.when(_has(x["source"]), F.concat(F.lit(">   **Source:** "), X.source_link(x["source"])))


def check_section() -> Column:
    fc = _c("check")
    size = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    disputed, verified, flags, sources = (fc[k] for k in ("disputed_claims", "verified_claims", "flags", "sources"))

    def group(title, xs, line):
        return F.when(size(xs), F.concat_ws("\n", F.lit(title) if title else None, F.array_join(F.transform(xs, line), "\n")))

    def dispute(d):
        return _lines(F.concat(F.lit("> - **Claimed:** "), F.coalesce(d["claim"], F.lit(""))),
                      _line(_has(d["reality"]), ">   **Reality:** ", d["reality"]), _source_line(d))

    def verify(v):
        return F.concat(F.lit("> - "), F.coalesce(v["claim"], F.lit("")),
                        _when(_has(v["source"]), " — ", X.source_link(v["source"])))

    def flag(f):
        kind = F.coalesce(F.nullif(f["type"], F.lit("")), F.nullif(f["label"], F.lit("")))
        typed = _lines(F.concat(F.lit("> - "), F.when(f["severity"] == "warning", "⚠️ ").otherwise(""), F.lit("**"),
                                X.humanise(kind), F.lit(":** "), F.coalesce(f["detail"], F.lit(""))), _source_line(f))
        return F.when(kind.isNull() & f["severity"].isNull(), F.concat(F.lit("> - "), f["detail"])).otherwise(typed)

    text = _lines(
        F.when(_warned(), "> [!warning]- Fact Check").otherwise("> [!info]- Fact Check"),
        F.when(F.coalesce(fc["opinion_only"], F.lit(False)) & ~size(disputed) & ~size(verified),
               "> This content is opinion/analysis — no specific factual claims were verified."),
        group("> **Disputed Claims:**", disputed, dispute), group("> **Verified Claims:**", verified, verify),
        group("> **Flags:**", flags, flag),
        F.when(~size(disputed) & ~size(verified) & ~size(flags), "> No specific factual claims were flagged as disputed."),
        group("> **Sources:**", sources, lambda s: F.concat(F.lit("> - "), X.source_link(s))))
    return F.when(fc.isNotNull(), F.concat(text, F.lit("\n"))).otherwise("")


def check_warning() -> Column:
    fc = _c("check")
    disputes = F.transform(fc["disputed_claims"], lambda d: _lines(
        F.concat(F.lit("> - **Claimed:** "), F.coalesce(d["claim"], F.lit(""))),
        F.concat(F.lit(">   **Reality:** "), F.coalesce(d["reality"], F.lit(""))), _source_line(d)))
    bad = F.transform(F.filter(fc["flags"], lambda f: f["severity"] == "warning"), lambda f: _lines(
        F.concat(F.lit("> - **"), X.humanise(F.coalesce(f["type"], F.lit("flag"))), F.lit(":** "), F.coalesce(f["detail"], F.lit(""))),
        _source_line(f)))
    return _when(_warned(), F.concat_ws("\n", F.lit("> [!warning] Fact-Check Flags"), disputes, bad), "\n")


def location_callout() -> Column:
    lc = _c("location_check")
    disputed = F.coalesce(lc["location_disputed"], F.lit(False))
    some = disputed | (F.coalesce(F.size(lc["advisories"]), F.lit(0)) > 0)
    advice = F.transform(lc["advisories"], lambda a: F.concat(
        F.lit("> - **"), X.humanise(F.coalesce(a["type"], F.lit("advisory"))), F.lit(":** "), F.coalesce(a["detail"], F.lit(""))))
    return _when(some, F.concat_ws(
        "\n", F.when(disputed, "> [!warning] Location Dispute Flagged").otherwise("> [!warning] Travel Advisory"),
        _line(disputed, "> - **Stated:** ", F.coalesce(lc["stated_location"], F.lit("unknown"))),
        _line(disputed, "> - **Claimed actual:** ", F.coalesce(lc["claimed_actual_location"], F.lit("unknown")), " (",
              F.coalesce(lc["confidence"], F.lit("")), " confidence)"),
        _line(disputed & _has(lc["evidence"]), "> - **Evidence:** ", lc["evidence"]), advice), "\n")


# ---- off-site provenance ---------------------------------------------------------------------

def followed_page() -> Column:
    md = X.strip(F.coalesce(_c("followed_markdown"), F.lit("")))
    url = F.coalesce(_c("followed_url"), F.lit(""))
    host = U.domain(url)
    return _when(md != "", "---\n\n## 📄 Full Web Clipping", _when(host != "", " — ", host), "\n\n",
                 _when(url != "", "> [!info] 📎 Reproduced in full from ", X.host_link(url),
                       " so the recipe survives if the original post or page is taken down.\n\n"),
                 M.demote_headings(M.drop_lead_title(md)), "\n")


def offsite() -> Column:
    title = "🔗 Recipe from Bio / Off-Site Link"
    url, hint, page = _c("followed_url"), _c("hint"), followed_page()
    link = X.host_link(url)
    shown = X.strip(F.coalesce(_c("followed_markdown"), F.lit(""))) != ""
    banner = F.when(has_recipe(), F.concat(
        F.lit(f"> [!success]+ {title}\n> The recipe above was extracted automatically from "), link, F.lit("."),
        F.when(shown, " The full source page is reproduced below.").otherwise(""), F.lit("\n"))) \
        .when(shown, F.concat(F.lit(f"> [!warning]+ {title}\n> I followed the off-site link ("), link, F.lit(
            ") but could not parse a clean structured recipe from it — the full source page is reproduced below so nothing is lost.\n"))) \
        .otherwise(F.concat(F.lit(f"> [!warning] {title}\n> I followed the off-site link ("), link, F.lit(
            ") but could not find a structured recipe on that page — open it directly to check.\n")))
    pointed = F.coalesce(_c("offsite_detected"), F.lit(False))
    return F.when(_has(url), F.concat(banner, F.when(shown, F.concat(F.lit("\n"), page)).otherwise(""))) \
        .when(_has(hint), F.concat(
            F.lit(f"> [!warning] {title}\n> This post points to an off-site recipe, but I could not open it automatically. Try the link the poster shared: "),
            X.host_link(hint), F.lit("\n"))) \
        .when(pointed, F.lit(f"> [!warning] {title}\n> This post points to an off-site recipe (\"link in bio\"), but I could not locate or extract the recipe automatically.\n")) \
        .otherwise("")


# ---- header ----------------------------------------------------------------------------------

def header(run_date: Column, type_label: str) -> Column:
    author = F.coalesce(F.nullif(_c("author"), F.lit("")), F.lit("unknown"))
    quoted = lambda name, v: F.concat(F.lit(f'{name}: "'), v, F.lit('"'))
    post_title = X.yaml_safe(F.coalesce(_c("post_title"), F.lit("")))
    p = _c("platform")
    user = _after_slash(author)
    sub = _c("metadata.subreddit")
    h = _handle()
    date = F.when(p == "reddit", F.when(_raw_date("epoch").isNotNull(), X.posted_date(_raw_date("epoch")))) \
            .when(p == "youtube", F.when(_has(_c("metadata.upload_date")), X.posted_date(_c("metadata.upload_date")))) \
            .otherwise(posted())
    named = p.isin("reddit", "youtube", "instagram", "tiktok")
    host = U.netloc(_c("url"))
    tags = F.coalesce(_c("tags"), F.array().cast("array<string>"))
    tag_lines = F.when(F.size(tags) > 0, F.concat(F.lit("tags:\n"), F.array_join(F.transform(
        tags, lambda t: F.concat(F.lit('  - "'), F.replace(t, F.lit('"'), F.lit("'")), F.lit('"'))), "\n"))).otherwise("tags: []")
    return _lines(
        F.lit("---"), quoted("title", X.yaml_safe(F.coalesce(_c("title"), F.lit("")))),
        F.when((post_title != "") & (post_title != _c("url")), quoted("post_title", post_title)),
        quoted("source_url", _c("url")), F.concat(F.lit("platform: "), p), F.concat(F.lit("saved_date: "), run_date),
        quoted("author", author),
        F.when((p == "reddit") & ~user.isin("unknown", ""), quoted("author_url", F.concat(F.lit("https://reddit.com/u/"), user))),
        F.when((p == "reddit") & _has(sub), F.concat(F.lit("subreddit: r/"), sub)),
        F.when((p == "reddit") & _has(sub), quoted("subreddit_url", F.concat(F.lit("https://reddit.com/r/"), sub))),
        F.when((p == "youtube") & _has(_c("metadata.channel_id")),
               quoted("channel_url", F.concat(F.lit("https://youtube.com/channel/"), _c("metadata.channel_id")))),
        F.when((p == "instagram") & (h != ""), quoted("author_url", F.concat(F.lit("https://instagram.com/"), h))),
        F.when((p == "tiktok") & (h != ""), quoted("author_url", F.concat(F.lit("https://tiktok.com/@"), h))),
        F.when(~named & (host != ""), F.concat(F.lit("domain: "), host)),
        F.when(_has(date), F.concat(F.lit("posted: "), date)),
        F.when((p == "reddit") & _has(_c("youtube.channel")), quoted("youtube_channel", _c("youtube.channel"))),
        F.when((p == "reddit") & _has(_c("youtube.channel")) & _has(_c("youtube.channel_id")),
               quoted("youtube_channel_url", F.concat(F.lit("https://youtube.com/channel/"), _c("youtube.channel_id")))),
        tag_lines, F.lit(f"type: {type_label}"), F.lit("---"))

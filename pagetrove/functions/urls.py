"""URL expressions. All are native Column expressions so scans stay inside codegen."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagetrove.functions.text import let, slug

# --- fixed values -----------------------------------------------------------------------------
LEDGER_TRACKING_KEYS = ["igsh", "igshid", "fbclid", "ref", "share_id"]
LINK_TRACKING_KEYS = [
    "fbclid", "gclid", "mc_cid", "mc_eid", "igshid", "igsh", "aem", "_aem", "ref", "ref_src",
]
REDIRECT_PARAMS = ["u", "url", "target", "redirect", "q", "link"]
REDIRECT_PARAMS_ANY_HOST = ["url", "target", "redirect"]
PLATFORM_HOSTS = {
    "reddit": ["reddit.com", "redd.it"],
    "youtube": ["youtube.com", "youtu.be"],
    "instagram": ["instagram.com"],
    "tiktok": ["tiktok.com", "vm.tiktok.com"],
    "facebook": ["facebook.com", "fb.com", "fb.watch"],
}
SITE_LABELS = {"provecho.co": "provecho"}
AGGREGATOR_HOSTS = [
    "linktr.ee", "linktree.com", "beacons.ai", "beacons.page", "stan.store", "komi.io",
    "snipfeed.co", "flowpage.com", "milkshake.app", "tap.bio", "campsite.bio", "shor.by",
    "allmylinks.com", "lnk.bio", "bio.link", "solo.to", "msha.ke", "withkoji.com",
    "linkin.bio", "later.com", "hoo.be", "pillar.io", "linkpop.com", "carrd.co",
]
NEVER_RECIPE_HOSTS = [
    "instagram.com", "tiktok.com", "youtube.com", "youtu.be", "facebook.com", "fb.com",
    "twitter.com", "x.com", "threads.net", "snapchat.com", "spotify.com", "apple.com",
    "amazon.", "patreon.com", "cameo.com", "venmo.com", "paypal.", "cash.app", "ko-fi.com",
    "buymeacoffee.com", "discord.gg", "discord.com", "t.me", "whatsapp.com",
]
VIDEO_HOST_MARKS = [
    "v.redd.it", "redditmedia.com", "reddit.com/video", "tiktok.com", "youtube.com", "youtu.be",
    "instagram.com/reel", "facebook.com/watch",
]
SPELLED_TLDS = "com|net|org|io|co|blog|shop|store|kitchen|recipes?|food|us|uk|ca|au|eu"
IMAGE_EXTENSIONS = [".jpg", ".jpeg", ".png", ".gif", ".webp", ".avif", ".heic", ".heif"]
VIDEO_EXTENSIONS = [".mp4", ".webm", ".mov", ".mkv"]
AUDIO_VIDEO_EXTENSIONS = [
    ".mp4", ".mkv", ".webm", ".mov", ".avi", ".flv", ".m4v", ".ts", ".3gp",
    ".mp3", ".m4a", ".aac", ".wav", ".flac", ".ogg", ".opus", ".wma",
]
# ----------------------------------------------------------------------------------------------

URL_IN_LINE = r"""https?://[^\s\)\]\>"']+"""
URL_IN_CAPTION = r"""(?i)(https?://[^\s)\]"'<>]+)"""


def _any(cols):
    out = F.lit(False)
    for c in cols:
        out = out | c
    return out


def head(url: Column) -> Column:
    """Everything before the query and fragment, scheme lower-cased."""
    raw = F.regexp_extract(url, r"^([^?#]*)", 1)
    scheme = F.regexp_extract(raw, r"^([A-Za-z][A-Za-z0-9+.-]*:)?", 1)
    return F.concat(F.lower(scheme), F.substr(raw, F.length(scheme) + 1))


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)


def fragment(url: Column) -> Column:
    return F.regexp_extract(url, r"^[^#]*#(.*)$", 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def domain(url: Column, compat=False) -> Column:
    """Host without a leading ``www.``. ``compat`` strips any run of ``w`` and ``.`` instead."""
    return F.regexp_replace(netloc(url), r"^[w.]+" if compat else r"^www\.", "")


def host(url: Column, compat=False) -> Column:
    return F.regexp_replace(F.lower(netloc(url)), r"^[w.]+" if compat else r"^www\.", "")


def form_decode(x: Column) -> Column:
    return F.try_url_decode(F.regexp_replace(x, r"%(?![0-9A-Fa-f]{2})", "%25"))


def form_encode(x: Column) -> Column:
    return F.replace(F.replace(F.url_encode(x), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(url: Column) -> Column:
    """Query string as an ordered array of decoded (k, v) structs; blank values are kept."""
    parts = F.filter(F.split(query(url), "&"), lambda p: p != "")
    return F.transform(parts, lambda p: F.struct(
        form_decode(F.regexp_extract(p, r"^([^=]*)", 1)).alias("k"),
        form_decode(F.regexp_extract(p, r"^[^=]*=(.*)$", 1)).alias("v")))


def _with_query(url, pairs):
    q = F.array_join(F.transform(
        pairs, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"]))), "&")
    return let(q, lambda x: F.concat(
        head(url), F.when(x != "", F.concat(F.lit("?"), x)).otherwise(""),
        F.regexp_extract(url, "(#.+)$", 1)))


def canonical_url(url: Column) -> Column:
    """Ledger key: tracking parameters gone, repeated keys grouped at their first position."""
    kept = F.filter(query_pairs(url), lambda p: ~(
        p["k"].startswith("utm_") | p["k"].isin(*LEDGER_TRACKING_KEYS)))
    grouped = let(kept, lambda ps: F.flatten(F.transform(
        F.array_distinct(F.transform(ps, lambda p: p["k"])),
        lambda k: F.filter(ps, lambda p: p["k"] == k))))
    plain = F.regexp_replace(F.concat(head(url), F.regexp_extract(url, "(#.*)$", 1)), "#$", "")
    return F.when(url.contains("?"), _with_query(url, grouped)).otherwise(plain)


def clean_url(url: Column) -> Column:
    """Source link for display: wider tracking list, keys compared lower-case, order kept."""
    kept = F.filter(query_pairs(url), lambda p: ~(
        F.lower(p["k"]).startswith("utm_") | F.lower(p["k"]).isin(*LINK_TRACKING_KEYS)))
    return F.when(query(url) == "", url).otherwise(_with_query(url, kept))


def urls_in_line(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(URL_IN_LINE), 0),
                       lambda u: F.regexp_replace(u, r"[.,;!?]+$", ""))


def unwrap_redirect(url: Column) -> Column:
    """Target of an outbound-link wrapper, or the URL itself."""
    h = F.lower(netloc(url))
    wrapper = (_any([h.startswith(p) for p in
                     ("l.instagram.com", "l.facebook.com", "lm.facebook.com", "out.reddit.com")])
               | h.endswith("l.tiktok.com") | path(url).contains("/redirect"))

    def inner(pairs, name):
        first = F.get(F.filter(pairs, lambda p: (p["k"] == name) & (p["v"] != "")), F.lit(0))["v"]
        target = F.coalesce(F.try_url_decode(F.replace(F.regexp_replace(
            first, r"%(?![0-9A-Fa-f]{2})", "%25"), F.lit("+"), F.lit("%2B"))), first)
        ok = target.startswith("http")
        return F.when(ok if name in REDIRECT_PARAMS_ANY_HOST else ok & wrapper, target)

    return F.when(query(url) == "", url).otherwise(let(query_pairs(url), lambda pairs: F.coalesce(
        *[inner(pairs, n) for n in REDIRECT_PARAMS], url)))


def _on(h, site):
    return (h == site) | h.endswith("." + site)


def platform(url: Column, compat=False) -> Column:
    h = host(url, compat)
    # A listed host matches itself; sub-domains count for the main host of the platform.
    case = None
    for name, hosts in PLATFORM_HOSTS.items():
        cond = _on(h, hosts[0]) | h.isin(*hosts)
        case = F.when(cond, name) if case is None else case.when(cond, name)
    return case.otherwise("generic")


def site_label(url: Column, labels=SITE_LABELS) -> Column:
    h = F.regexp_replace(F.lower(netloc(url)), r"^www\.", "")
    case = None
    for site, name in labels.items():
        case = F.when(h == site, name) if case is None else case.when(h == site, name)
    return case.otherwise("generic") if case is not None else F.lit("generic")


def _first_group(url, pattern):
    return F.nullif(F.regexp_extract(url, pattern, 1), F.lit(""))


def item_id(url: Column) -> Column:
    return _first_group(url, r"/(?:video|photo)/([0-9]+)")


def shortcode(url: Column) -> Column:
    return _first_group(url, r"/(?:p|reel|tv)/([^/?#]+)")


def subreddit(url: Column) -> Column:
    name = _first_group(url, r"reddit\.com/r/([^/]+)")
    return F.coalesce(F.concat(F.lit("r/"), name), F.lit("unknown subreddit"))


def is_photo_post(url: Column) -> Column:
    return url.contains("/photo/")


def is_short(url: Column) -> Column:
    return url.contains("/shorts/")


def is_site_root(url: Column) -> Column:
    return F.regexp_replace(path(url), r"^/+|/+$", "") == ""


def on_video_host(url: Column) -> Column:
    return _any([url.contains(m) for m in VIDEO_HOST_MARKS])


def is_aggregator(url: Column, compat=False) -> Column:
    h = host(url, compat)
    return _any([_on(h, s) for s in AGGREGATOR_HOSTS])


def names_never_recipe_host(url: Column) -> Column:
    low = F.lower(url)
    return _any([low.contains(s) for s in NEVER_RECIPE_HOSTS])


def is_external_candidate(url: Column, exclude_host=None) -> Column:
    h = host(url)
    keep = (h != "") & ~names_never_recipe_host(url)
    return keep if exclude_host is None else keep & ~h.eqNullSafe(exclude_host)


def profile_url(platform_col: Column, handle: Column) -> Column:
    h = F.regexp_replace(F.trim(F.coalesce(handle, F.lit(""))), r"^@+", "")
    usable = (h != "") & ~h.rlike(r"(?U)\s")
    return F.when(usable & (platform_col == "instagram"),
                  F.concat(F.lit("https://www.instagram.com/"), h, F.lit("/"))) \
            .when(usable & (platform_col == "tiktok"),
                  F.concat(F.lit("https://www.tiktok.com/@"), h)) \
            .when(usable & (platform_col == "facebook"),
                  F.concat(F.lit("https://www.facebook.com/"), h))


def source_key(platform_col: Column, author: Column, subreddit_col: Column,
               domain_col: Column) -> Column:
    def present(c):
        return F.nullif(c, F.lit(""))
    handle = F.regexp_replace(present(author), r"^@+", "")
    return F.when(platform_col == "reddit", F.concat(F.lit("reddit:r/"), present(subreddit_col))) \
            .when(platform_col == "youtube", F.concat(F.lit("youtube:"), present(author))) \
            .when(platform_col.isin("instagram", "tiktok", "facebook"),
                  F.concat(platform_col, F.lit(":"), handle)) \
            .when(platform_col == "generic", F.concat(F.lit("domain:"), present(domain_col)))


def extension(path_col: Column) -> Column:
    return F.lower(F.regexp_extract(F.regexp_extract(path_col, r"^([^?#]*)", 1),
                                    r"(\.[A-Za-z0-9]+)$", 1))


def media_route(url: Column) -> Column:
    """Download route: video file or video host, image file, otherwise try as video first."""
    return F.when(extension(url).isin(*VIDEO_EXTENSIONS) | on_video_host(url), "video") \
            .when(extension(url).isin(*IMAGE_EXTENSIONS), "image").otherwise("try_video")


def is_audio_video(path_col: Column) -> Column:
    return extension(path_col).isin(*AUDIO_VIDEO_EXTENSIONS)


def pasted_links(text: Column) -> Column:
    """Distinct URLs pasted in a caption, trailing ``.,;`` removed and redirects unwrapped."""
    raw = F.regexp_extract_all(text, F.lit(URL_IN_CAPTION), 1)
    return F.array_distinct(F.transform(
        raw, lambda u: unwrap_redirect(F.regexp_replace(u, r"[.,;]+$", ""))))


def spelled_links(text: Column) -> Column:
    """Domains written out to dodge link detection (``name dot com``), as https URLs."""
    pat = (r"(?i)\b([a-z0-9](?:[a-z0-9-]*[a-z0-9])?)\s*(?:dot|\.)\s*(" + SPELLED_TLDS + r")\b")
    names = F.regexp_extract_all(text, F.lit(pat), 1)
    tlds = F.regexp_extract_all(text, F.lit(pat), 2)
    return F.array_distinct(F.zip_with(names, tlds, lambda n, t: F.concat(
        F.lit("https://"), F.lower(n), F.lit("."), F.lower(t))))


def source_subdir(author: Column, title: Column, url: Column) -> Column:
    digest = F.substring(F.md5(F.coalesce(F.nullif(url, F.lit("")), title, F.lit(""))), 1, 10)
    named = F.coalesce(author, F.lit("")) != ""
    base = F.when(named & (F.lower(author) != "unknown"), slug(author, 24, "media"))
    return F.concat_ws("-", base, digest)

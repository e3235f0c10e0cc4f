"""Text and URL expressions on columns; all stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .keys import SENTINELS

#: Fixed values.
BOT_NEEDLES = ("bot", "automod", "modteam", "removal", "helper", "reminder", "converter", "translator")
IMAGE_EXTENSIONS = ("jpg", "jpeg", "png", "gif", "webp", "bmp")
VIDEO_DOMAINS = ("v.redd.it", "youtube.com", "youtu.be", "vimeo.com", "streamable.com", "twitch.tv", "clips.twitch.tv", "tiktok.com", "instagram.com", "dailymotion.com")
IMAGE_HOSTS = ("imgur.com", "i.imgur.com", "giphy.com", "gfycat.com")
ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def unescape(c: Column) -> Column:
    """The core HTML entities decoded; &amp; last, so that nothing is decoded twice."""
    for name, sign in ENTITIES:
        c = F.replace(c, F.lit(name), F.lit(sign))
    return c


def clean_text(c: Column) -> Column:
    """Rule and comment text without markup and without a leading "Rule 1:" or "General -"; null gives ''.

    A text that would be blank without its prefix keeps it.
    """
    t = unescape(F.coalesce(c, F.lit("")))
    for pattern, new in ((r"<[^>]+>", ""), (r"\[([^\]]+)\]\([^)]+\)", "$1"), (r"https?://\S+", ""), (r"\*\*([^*]+)\*\*", "$1"), (r"\*([^*]+)\*", "$1"), (r"(?m)^#+\s*", ""), (r"```[^`]*```", ""), (r"`([^`]+)`", "$1")):
        t = F.regexp_replace(t, pattern, new)
    bare = F.regexp_replace(F.regexp_replace(t, r"(?i)^Rule\s*\d+[.\w]*\s*[:\-.]\s+", ""), r"(?i)^General\s*[:\-.]\s+", "")
    return F.trim(F.regexp_replace(F.when(F.trim(bare) == "", t).otherwise(bare), r"(?U)\s+", " "))


def rule_text(short_name: Column, description: Column, violation: Column) -> Column:
    """The composed text of a rule from its cleaned parts."""
    head = F.when(violation != "", F.concat(F.lit("Violation: "), violation, F.lit("\n"))).otherwise("")
    return F.trim(F.concat(head, F.lit("Rule: "), F.rtrim(short_name, F.lit(".")), F.lit(". "), description))


def is_bot(author: Column) -> Column:
    a = F.lower(F.coalesce(author, F.lit("")))
    return (a == "") | a.isin(*SENTINELS) | a.rlike("|".join(BOT_NEEDLES))


def without_mentions(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)u/\w+", "")


def answer_choice(c: Column) -> Column:
    """The first letter a-z of a reply as (x); '' where there is none."""
    letter = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), "([a-z])", 1)
    return F.when(letter != "", F.concat(F.lit("("), letter, F.lit(")"))).otherwise("")


def strict_choice(c: Column) -> Column:
    """The answer of a reply that is or ends in a single choice such as (b) or b.; '' otherwise."""
    letter = F.regexp_extract(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"(?:^|\s)\(?([a-z])\)?[.!]?$", 1)
    return F.when(letter != "", F.concat(F.lit("("), letter, F.lit(")"))).otherwise("")


def judged_right(c: Column) -> Column:
    t = F.lower(F.coalesce(c, F.lit("")))
    return t.contains("a") & ~t.contains("b") & ~t.contains("c")


def language_root(c: Column) -> Column:
    return F.coalesce(F.split_part(F.replace(c, F.lit("_"), F.lit("-")), F.lit("-"), F.lit(1)), F.lit("unknown"))


def timestamp_text(epoch: Column) -> Column:
    return F.date_format(F.timestamp_seconds(epoch), "EEE, MMM d, yyyy, h:mma")


def first_letter_bucket(c: Column) -> Column:
    first = F.lower(F.left(c, F.lit(1)))
    return F.when(first.rlike(r"^[\p{L}\p{N}]$"), first).otherwise("_")


def url_host(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))


def url_extension(url: Column) -> Column:
    """Image extension of the path of a URL; null for any other."""
    path = F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    ext = F.regexp_extract(path, r"\.([^.]*)$", 1)
    return F.when(ext.isin(*IMAGE_EXTENSIONS), ext)


def is_video(flag: Column, url: Column, metadata: Column) -> Column:
    host = url_host(F.coalesce(url, F.lit("")))
    by_host = host.rlike("|".join(d.replace(".", r"\.") for d in VIDEO_DOMAINS))
    by_item = F.coalesce(F.exists(F.map_values(metadata), lambda v: v["e"].isin("Video", "RedditVideo")), F.lit(False))
    return F.coalesce(flag, F.lit(False)) | by_host | by_item


def is_likely_image(url: Column) -> Column:
    """True for links that likely lead to an image: by extension or host, and neither a video's nor the site's own page."""
    host = url_host(url)
    video = host.rlike("|".join(d.replace(".", r"\.") for d in VIDEO_DOMAINS)) | url.contains("reddit.com/gallery/")
    own = host.contains("reddit.com") & ~host.contains("i.redd.it")
    known = host.rlike("|".join(d.replace(".", r"\.") for d in IMAGE_HOSTS))
    return F.coalesce(~video & ~own & (url_extension(url).isNotNull() | known), F.lit(False))


def media_urls(metadata: Column, url: Column) -> Column:
    """Media of a submission by priority, images of the gallery before the link itself: array of (url, source)."""
    item = lambda u, s: F.struct(F.replace(u, F.lit("&amp;"), F.lit("&")).alias("url"), F.lit(s).alias("source"))
    gallery = F.transform(F.filter(F.map_entries(metadata), lambda e: (e["value"]["e"] == "Image") & e["value"]["s"]["u"].isNotNull()), lambda e: item(e["value"]["s"]["u"], "media_metadata"))
    direct = F.array(item(url, "url"))
    none = F.array().cast("array<struct<url:string,source:string>>")
    return F.when(F.size(gallery) > 0, gallery).when(is_likely_image(url), direct).otherwise(none)


def error_category(c: Column) -> Column:
    low = F.lower(c)
    out = F.when(c.contains("404") | low.contains("not found"), "404_not_found").when(c.contains("403") | low.contains("forbidden"), "403_forbidden").when(c.contains("429") | low.contains("too many"), "429_rate_limited")
    for needle, name in (("timeout", "timeout"), ("connection", "connection_error"), ("ssl", "ssl_error"), ("certificate", "ssl_error"), ("content-type", "invalid_content_type")):
        out = out.when(low.contains(needle), name)
    return out.otherwise("other_error")


def media_status(ok: Column, expected: Column, nsfw: Column, crosspost: Column) -> Column:
    return F.when(nsfw, "skipped_nsfw").when(crosspost, "skipped_crosspost").when(expected == 0, "no_media").when(ok == expected, "complete").when(ok > 0, "partial").otherwise("failed")


def sanitized_id(c: Column) -> Column:
    return F.substring(F.translate(c, "|/\\", "___"), 1, 50)


def prompt(community: Column, rules: Column, title: Column, body: Column, thread: Column, question: str) -> Column:
    """The text of one question: community, numbered rules, submission, discussion; parts without content are left out."""
    part = lambda head, c: F.when(F.coalesce(c, F.lit("")) != "", F.concat(F.lit(head), c))
    numbered = F.array_join(F.transform(rules, lambda r, i: F.concat((i + 1).cast("string"), F.lit(". "), r)), "\n")
    return F.concat_ws("\n\n", part("Community: ", community), part("Rules:\n", numbered), part("Title: ", title), part("Body: ", body), part("Discussion:\n", F.array_join(thread, "\n")), F.lit(question))


def interleaved(text: Column, marker: str = "Body: ") -> Column:
    """(before, after) the first marker, between which images go; after is null without one."""
    at = F.instr(text, marker)
    return F.struct(F.when(at > 0, F.substring(text, F.lit(1), at + len(marker) - 1)).otherwise(text).alias("before"), F.when(at > 0, F.substring(text, at + len(marker), F.length(text))).alias("after"))

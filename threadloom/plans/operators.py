"""Queries that run the DataFrame operators, with independent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.keys import bare_id, community_key
from ..operators import clustering, documents, geometry, matching, splitting, statistics, threads
from ..session import cut
from ..sources.tables import table
from .relational import _full
from .reply_trees import _LINKS, reply_trees


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    low = lambda c: F.lower(F.nullif(F.trim(c), F.lit("")))
    rows = table(spark, folder, "thread_pairs").select(bare_id("mod_comment_id").alias("pair"), community_key("subreddit").alias("sub"), bare_id("submission_id").alias("submission"), "rule", low("rule_cluster_label").alias("label"), low("split").alias("split"), bare_id("violating_comment_id").alias("violating"), bare_id("compliant_comment_id").alias("compliant"), "violating_score", "compliant_score")
    return rows.where("pair is not null").groupBy("pair").agg(*[F.max(c).alias(c) for c in rows.columns[1:]])


def _comments(spark: SparkSession, folder: str) -> DataFrame:
    """One row an id, a row with text before one without."""
    c = table(spark, folder, "comments")
    gone = F.coalesce(F.trim("body_clean"), F.lit("")).isin("", "[removed]", "[deleted]") | F.coalesce("author", F.lit("[deleted]")).isin("[removed]", "[deleted]")
    rows = c.select(bare_id("id").alias("id"), community_key("subreddit").alias("sub"), bare_id("parent_id").alias("parent"), bare_id("link_id").alias("link"), "author", "body_clean", "distinguished", "score", "raw", "created_utc", gone.alias("gone"), "retrieved_at").where("id is not null")
    order = F.struct("gone", "retrieved_at", F.coalesce("score", F.lit(-999999)), F.coalesce("author", F.lit("")), F.coalesce("raw", F.lit("")))
    return rows.groupBy("id").agg(F.min_by(F.struct(*rows.columns[1:]), order).alias("r")).select("id", "r.*")


def scl01_clean_text(spark, folder):
    return table(spark, folder, "comments").select(bare_id("id").alias("id"), X.clean_text(F.col("body")).alias("body_clean")).distinct()


def prj02_rule_text(spark, folder):
    rules = table(spark, folder, "subreddits").select(community_key("subreddit").alias("sub"), F.explode("rules").alias("r"))
    parts = [X.clean_text(F.col(f"r.{c}")) for c in ("short_name", "description", "violation_reason")]
    return rules.select("sub", F.col("r.rule_index").alias("rule_index"), parts[0].alias("short_name"), X.rule_text(*parts).alias("whole")).distinct()


def flt04_bots(spark, folder):
    return table(spark, folder, "comments").select("author").distinct().select("author", X.is_bot(F.col("author")).alias("bot"))


def scl05_language_root(spark, folder):
    return table(spark, folder, "documents").groupBy(X.language_root(F.col("lang")).alias("root")).agg(F.count("*").alias("n"))


def scl06_timestamp(spark, folder):
    return table(spark, folder, "submissions").select(bare_id("id").alias("id"), X.timestamp_text(F.col("created_utc")).alias("text")).distinct()


def scl07_mentions(spark, folder):
    return table(spark, folder, "comments").where(F.col("body_clean").contains("u/")).select(bare_id("id").alias("id"), X.without_mentions(F.col("body_clean")).alias("text")).distinct()


def scl08_answers(spark, folder):
    d = table(spark, folder, "documents")
    return d.select("doc_id", X.answer_choice(F.col("text")).alias("choice"), X.judged_right(F.substring(F.col("text"), 1, 1)).alias("judged"))


def scl09_judged(spark, folder):
    return table(spark, folder, "documents").select("doc_id", X.judged_right(F.col("text")).alias("judged"))


def scl12_errors(spark, folder):
    e = table(spark, folder, "events").select("event_id", F.concat(F.col("event_type"), F.lit(" "), F.pmod(F.col("event_id"), F.lit(500)).cast("string"), F.when(F.col("user_id") % 5 == 0, " timeout").otherwise("")).alias("message"))
    return e.select(X.error_category(F.col("message")).alias("category")).groupBy("category").agg(F.count("*").alias("n"))


def scl13_urls(spark, folder):
    s = table(spark, folder, "submissions").select("url").where("url is not null").distinct()
    return s.select("url", X.url_host(F.col("url")).alias("host"), X.url_extension(F.col("url")).alias("ext"))


def scl17_media(spark, folder):
    s = table(spark, folder, "submissions")
    each = s.select(bare_id("id").alias("id"), F.explode(X.media_urls(F.col("media_metadata"), F.col("url"))).alias("m"))
    return each.select("id", "m.url", "m.source").distinct()


def scl19_status(spark, folder):
    s = table(spark, folder, "submissions")
    n = F.size(X.media_urls(F.col("media_metadata"), F.col("url")))
    status = X.media_status(F.greatest(n - 1, F.lit(0)), n, F.coalesce("over_18", F.lit(False)), F.col("crosspost_parent").isNotNull())
    return s.select(status.alias("status")).groupBy("status").agg(F.count("*").alias("n"))


def flt11_edited(spark, folder):
    """Absent and false count as unedited, null and a time as edited: presence is read from the keys, as null and absent differ."""
    raw = table(spark, folder, "comments").select(bare_id("id").alias("id"), "raw").distinct()
    present = F.array_contains(F.json_object_keys("raw"), "edited")
    edited = F.coalesce(present & ~F.coalesce(F.get_json_object("raw", "$.edited") == "false", F.lit(False)), F.lit(False))
    return raw.groupBy("id").agg(F.max(edited).alias("edited"))


def tre01_edges(spark, folder):
    t = reply_trees(table(spark, folder, "comments"))
    return t.where("state = 'tree'").select("id", "root", "depth")


def _paths(spark, folder):
    return reply_trees(table(spark, folder, "comments"), paths=True).where("state = 'tree'")


def _facts(spark, folder):
    """What a comment can disqualify its thread by; of several rows of an id the one of _comments stands."""
    c = _comments(spark, folder)
    some = lambda key: ~F.coalesce(F.get_json_object("raw", f"$.{key}"), F.lit("")).isin("", "{}", "[]", "false", "0")
    removed = F.coalesce(F.trim("body_clean").isin("[removed]", "[deleted]"), F.lit(False)) | F.coalesce(F.trim("author").isin("[removed]", "[deleted]"), F.lit(False))
    edited = F.coalesce(F.array_contains(F.json_object_keys("raw"), "edited") & ~F.coalesce(F.get_json_object("raw", "$.edited") == "false", F.lit(False)), F.lit(False))
    rows = c.select("id", "parent", "score", "created_utc", removed.alias("removed"), (some("media") | some("media_metadata")).alias("media"), F.col("distinguished").eqNullSafe("moderator").alias("moderator"), edited.alias("edited"))
    answered = rows.where("moderator and parent is not null").select(F.col("parent").alias("id")).distinct().withColumn("mod_reply", F.lit(True))
    return rows.join(answered, "id", "left").withColumn("mod_reply", F.coalesce("mod_reply", F.lit(False)))


def _judged(spark, folder):
    """(pairs, nodes): pairs in the order in which their moderators wrote, and all comments of the trees that hold one, judged.

    Paths are judged in these trees only, and the result is written once, as both sides of the candidate join read it.
    """
    facts = _facts(spark, folder)
    all_nodes = cut(_paths(spark, folder).select(F.col("link").alias("tree"), "id", "parent", "depth", "path").where("tree is not null"))
    pairs = _pairs(spark, folder).where("violating is not null").select("pair", F.col("violating").alias("id"))
    wrote = facts.select(F.col("id").alias("pair"), F.col("created_utc").cast("double").alias("wrote"))
    turn = F.coalesce("wrote", F.lit(float("inf"))).alias("ord")
    pairs = pairs.join(wrote, "pair", "left").select("pair", "id", turn)
    held = all_nodes.join(pairs.select("id").distinct(), "id", "left_semi").select("tree").distinct()
    nodes = all_nodes.join(held, "tree", "left_semi")
    return pairs, cut(nodes.join(threads.first_issue(nodes.select("id", "path"), facts), "id").join(facts.select("id", "score"), "id"))


def _candidates(spark, folder):
    pairs, nodes = _judged(spark, folder)
    violating = pairs.join(nodes.where("violating is null").select("tree", "id", "parent", "depth", "path"), "id")
    return threads.candidates(violating, nodes.where("compliant is null").select("tree", "id", "depth", "path", "score"))


def tre06_best_sibling(spark, folder):
    b = threads.best(_candidates(spark, folder))
    return b.select("pair", F.col("id").alias("violating"), F.col("cand").alias("compliant"), "common", "length")


def tre06_candidates(spark, folder):
    return _candidates(spark, folder).groupBy("pair").agg(F.count("*").alias("candidates"), F.max("common").alias("most_common"))


def tre07_greedy(spark, folder):
    return threads.greedy(_candidates(spark, folder))


def tre04_first_issue(spark, folder):
    """Faults of the violating threads of pairs, and of all threads of their trees as compliant ones."""
    pairs, nodes = _judged(spark, folder)
    v = nodes.join(pairs, "id").select(F.lit("violating").alias("mode"), F.coalesce("violating", F.lit("none")).alias("issue"))
    c = nodes.select(F.lit("compliant").alias("mode"), F.coalesce("compliant", F.lit("none")).alias("issue"))
    return v.unionByName(c).groupBy("mode", "issue").agg(F.count("*").alias("n"))


def tre10_forest(spark, folder):
    t = _paths(spark, folder).where("link is not null").groupBy("link").agg(F.count("*").alias("comments"), F.max("depth").alias("deepest"), F.count_if(F.col("depth") == 0).alias("roots"))
    return t


def mth01_divergence(spark, folder):
    n = _pairs(spark, folder).where("rule is not null and sub is not null").groupBy("sub", "rule").agg(F.count("*").alias("n"))
    return statistics.divergence_from_uniform(n, "sub", "n").select("sub", F.round("divergence", 6).alias("divergence"))


def agg09_floor_percentiles(spark, folder):
    n = _pairs(spark, folder).groupBy("sub").agg(F.count("*").alias("n"))
    return statistics.floor_percentiles(n, "n", {"p25": 0.25, "p50": 0.5, "p75": 0.75, "p90": 0.9, "p95": 0.95})


def agg17_majority(spark, folder):
    votes = table(spark, folder, "subject_labels").select("doc_id", F.lower(F.trim("subject")).alias("subject"), F.substring("annotator", 2, 9).cast("int").alias("seen"))
    return statistics.majority(votes.where("subject is not null"), "doc_id", "subject", "seen")


def win02_filtered_rank(spark, folder):
    n = _pairs(spark, folder).where("sub is not null").groupBy("sub").agg(F.count("*").alias("n"))
    return statistics.filtered_rank(n, F.col("n") >= 3, [F.desc("n"), F.asc("sub")], "position")


def _results(spark, folder):
    p = _pairs(spark, folder)
    v, c = F.col("violating_score"), F.col("compliant_score")
    return p.select("pair", F.coalesce("label", F.lit("none")).alias("label"), F.coalesce("split", F.lit("none")).alias("split"), F.when(v.isNotNull() & c.isNotNull(), (v <= c).cast("double")).alias("violating"), F.when(c.isNotNull(), (c > 0).cast("double")).alias("compliant"))


def agg16_accuracy(spark, folder):
    return statistics.accuracy(_results(spark, folder), ["label", "split"])


def spl06_bootstrap(spark, folder):
    r = statistics.bootstrap_sides(_results(spark, folder), "label", ("violating", "compliant"))
    return r.select("kind", "label", "side", "n", *[F.round(c, 6).alias(c) for c in ("mean", "low", "high")])


def _vectors(spark, folder):
    e = table(spark, folder, "embeddings").select("vec_id", F.col("embedding").alias("vector"), (F.col("label") % 2).alias("grp"), "label")
    first = e.groupBy("label").agg(F.min("vec_id").alias("vec_id"))
    return e, e.join(first.select("vec_id"), "vec_id", "left_semi").select("grp", F.col("vec_id").alias("rule"), "vector")


def mth02_similarity(spark, folder):
    e, rules = _vectors(spark, folder)
    return matching.similarities(e, rules, "grp", "vec_id", "rule").withColumn("sim", F.round("sim", 5))


def match_rules(spark, folder):
    e, rules = _vectors(spark, folder)
    sims = matching.similarities(e, rules, "grp", "vec_id", "rule").withColumn("sim", F.round("sim", 5))
    found = matching.match(sims, matching.pooled_thresholds(sims, 0.95, 0.9), "grp", "vec_id", "rule")
    return found.select("grp", "vec_id", "status", "rule", "sim")


def spl01_adaptive_split(spark, folder):
    o = table(spark, folder, "orders").select("o_custkey", "o_orderkey")
    return splitting.adaptive_split(o, "o_custkey", "o_orderkey")


def spl03_options(spark, folder):
    rules = table(spark, folder, "subreddits").select(community_key("subreddit").alias("sub"), F.explode("rules.short_name_clean").alias("o")).where("o is not null").groupBy("sub").agg(F.array_sort(F.collect_set("o")).alias("options"))
    rows = _pairs(spark, folder).join(rules, "sub").select("pair", F.posexplode(splitting.shuffled_options(F.col("options"), F.col("pair"), "_v")).alias("pos", "x"))
    return rows.select("pair", "pos", "x.label", "x.option")


def spl04_stratified(spark, folder):
    p = _pairs(spark, folder).where("label is not null and sub is not null")
    return splitting.stratified_sample(p, "label", "sub", "pair", 40)


def _threads(spark, folder):
    m = table(spark, folder, "thread_members").select(bare_id("mod_comment_id").alias("pair"), "side", "level", bare_id("comment_id").alias("comment_id"))
    bodies = _comments(spark, folder).where("not gone").select("id", F.col("body_clean").alias("body"))
    return documents.thread_arrays(m, bodies, ["pair", "side"]), bodies


def doc02_dehydrate(spark, folder):
    t, _ = _threads(spark, folder)
    d = documents.dehydrate(t)
    return d.select("pair", "side", F.size("thread").cast("bigint").alias("length"), F.array_join(F.transform("thread", lambda c: c["id"]), ",").alias("ids"), F.coalesce(F.element_at("thread", 1)["body"], F.lit("")).alias("body"))


def doc04_roundtrip(spark, folder):
    """Threads without bodies, given them back: length, missing bodies and a hash of what came back."""
    t, bodies = _threads(spark, folder)
    back = documents.hydrate(documents.dehydrate(t), bodies, ["pair", "side"])
    text = F.array_join(F.transform("thread", lambda c: F.coalesce(c["body"], F.lit("missing"))), "|")
    return back.select("pair", "side", F.size("thread").cast("bigint").alias("length"), F.size(F.filter("thread", lambda c: ~c["found"])).cast("bigint").alias("missing"), F.sha2(text, 256).alias("digest"))


def scl22_prompt(spark, folder):
    rules = table(spark, folder, "subreddits").select(community_key("subreddit").alias("sub"), F.explode("rules").alias("r")).where("r.short_name_clean is not null").select("sub", "r.rule_index", F.col("r.short_name_clean").alias("name")).distinct()
    listed = rules.groupBy("sub").agg(F.transform(F.array_sort(F.collect_list(F.struct("rule_index", "name"))), lambda x: x["name"]).alias("rules"))
    rows = _pairs(spark, folder).join(listed, "sub")
    text = X.prompt(F.col("sub"), F.col("rules"), F.lit(None).cast("string"), F.col("rule"), F.array("violating", "compliant"), "Which rule is broken?")
    return rows.select("pair", F.sha2(text, 256).alias("digest"), X.interleaved(text)["before"].alias("before"))


def spl08_least_loaded(spark, folder):
    n = table(spark, folder, "comments").select(community_key("subreddit").alias("sub")).where("sub is not null").groupBy("sub").agg(F.count("*").alias("n"))
    return splitting.least_loaded(n, "sub", "n", 5)


def _points(spark, folder):
    return table(spark, folder, "embeddings").select("label", F.col("embedding")[0].alias("x"), F.col("embedding")[1].alias("y"))


def mth06_hulls(spark, folder):
    return geometry.hulls(_points(spark, folder), "label", "x", "y").select("label", "corner", F.round("px", 6).alias("x"), F.round("py", 6).alias("y"))


def mth07_colours(spark, folder):
    return geometry.colours(geometry.hulls(_points(spark, folder), "label", "x", "y"), "label")


def ext10_cluster_grid(spark, folder):
    return clustering.grid(table(spark, folder, "embeddings"), "vec_id", "embedding", [("kmeans", 5), ("kmeans", 8), ("bisecting", 8)]).withColumn("score", F.round("score", 4))


_MEMBER = "m AS (SELECT nullif(regexp_replace(trim(mod_comment_id), '^t[0-9]_', ''), '') AS pair, side, level, nullif(regexp_replace(trim(comment_id), '^t[0-9]_', ''), '') AS id FROM thread_members)"
_CLEAN = """regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  replace(replace(replace(replace(replace(replace(replace(coalesce({0}, ''), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&#x27;', ''''), '&nbsp;', ' '), '&amp;', '&'),
  '<[^>]+>', '', 'g'), '\\[([^\\]]+)\\]\\([^)]+\\)', '\\1', 'g'), 'https?://\\S+', '', 'g'), '\\*\\*([^*]+)\\*\\*', '\\1', 'g'), '\\*([^*]+)\\*', '\\1', 'g'), '(?m)^#+\\s*', '', 'g'), '```[^`]*```', '', 'g'), '`([^`]+)`', '\\1', 'g')"""
_BARE = "regexp_replace(regexp_replace({0}, '(?i)^Rule\\s*\\d+[.\\w]*\\s*[:\\-.]\\s+', ''), '(?i)^General\\s*[:\\-.]\\s+', '')"


def _clean_sql(c: str) -> str:
    t = _CLEAN.format(c)
    return f"trim(regexp_replace(CASE WHEN trim({_BARE.format(t)}) = '' THEN {t} ELSE {_BARE.format(t)} END, '\\s+', ' ', 'g'))"


_NODES = f"""WITH RECURSIVE {_full('SELECT * FROM c', 1).partition('WITH ')[2].rpartition('SELECT * FROM c')[0].strip()}, {_LINKS.strip()},
f AS (SELECT id, parent, score, coalesce(trim(body_clean) IN ('[removed]', '[deleted]'), false) OR coalesce(trim(author) IN ('[removed]', '[deleted]'), false) AS removed,
  coalesce(raw ->> '$.media', '') NOT IN ('', '{{}}', '[]', 'false', '0') OR coalesce(raw ->> '$.media_metadata', '') NOT IN ('', '{{}}', '[]', 'false', '0') AS media, coalesce(distinguished = 'moderator', false) AS moderator,
  coalesce(list_contains(json_keys(raw), 'edited') AND coalesce(json_extract(raw, '$.edited')::VARCHAR <> 'false', true), false) AS edited, coalesce(id IN (SELECT parent FROM c WHERE distinguished = 'moderator' AND parent IS NOT NULL), false) AS answered FROM c),
p AS (SELECT nullif(regexp_replace(trim(mod_comment_id), '^t[0-9]_', ''), '') AS pair, max(nullif(regexp_replace(trim(violating_comment_id), '^t[0-9]_', ''), '')) AS violating FROM thread_pairs GROUP BY 1 HAVING pair IS NOT NULL AND violating IS NOT NULL),
held AS (SELECT DISTINCT n.link FROM p JOIN node n ON n.id = p.violating JOIN walk w ON w.id = n.id WHERE NOT w.lost AND n.link IS NOT NULL),
th AS (SELECT w.id, n.parent, n.link AS tree, w.depth, w.path FROM walk w JOIN node n ON n.id = w.id WHERE NOT w.lost AND n.link IN (SELECT link FROM held)),
hop AS (SELECT th.id, th.depth - s.lvl AS up, s.at FROM th, LATERAL (SELECT unnest(string_split(th.path, '/')) AS at, generate_subscripts(string_split(th.path, '/'), 1) - 1 AS lvl) s),
up AS (SELECT h.id, min(CASE WHEN f.removed THEN up * 10 WHEN f.media THEN up * 10 + 1 WHEN f.moderator THEN up * 10 + 2 END) AS fault FROM hop h JOIN f ON f.id = h.at GROUP BY h.id),
j AS (SELECT th.*, f.score, least(u.fault, CASE WHEN f.edited THEN 3 END) AS v, least(u.fault, CASE WHEN f.answered THEN 4 END) AS k FROM th JOIN up u ON u.id = th.id JOIN f ON f.id = th.id),
cand AS (SELECT p.pair, v.tree, v.id, x.id AS cand, x.score, x.depth + 1 AS length, len(list_intersect(string_split(v.path, '/'), string_split(x.path, '/'))) AS common FROM p JOIN j v ON v.id = p.violating AND v.v IS NULL JOIN j x ON x.k IS NULL AND x.tree = v.tree AND (x.depth = v.depth OR (v.depth >= 2 AND x.depth = v.depth - 1)) AND x.id <> v.id AND x.id IS DISTINCT FROM v.parent)"""
_WORD = "CASE WHEN {0} IS NULL THEN 'none' ELSE ['removed_or_deleted', 'has_media', 'moderator_in_thread', 'edited_comment', 'mod_response'][{0} % 10 + 1] END"
_URLHOST = "lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_URLEXT = "CASE WHEN regexp_extract(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\\.([^.]*)$', 1) IN ('jpg', 'jpeg', 'png', 'gif', 'webp', 'bmp') THEN regexp_extract(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\\.([^.]*)$', 1) END"
_RES = """res AS (SELECT pair, coalesce(label, 'none') AS label, coalesce(split, 'none') AS split, CASE WHEN vscore IS NOT NULL AND cscore IS NOT NULL THEN CAST(vscore <= cscore AS INT) END AS violating, CASE WHEN cscore IS NOT NULL THEN CAST(cscore > 0 AS INT) END AS compliant FROM p)"""
_P = _full("SELECT 1 FROM p", 1).rpartition("SELECT 1 FROM p")[0].strip()
_SIM = "WITH e AS (SELECT vec_id, embedding AS v, label % 2 AS grp, label FROM embeddings), k AS (SELECT grp, vec_id AS rule, v FROM e WHERE vec_id IN (SELECT min(vec_id) FROM e GROUP BY label)), sims AS (SELECT e.grp, e.vec_id, k.rule, round(list_dot_product(e.v::DOUBLE[], k.v::DOUBLE[]), 5) AS sim FROM e JOIN k ON e.grp = k.grp)"

ORACLE = {
    "scl01_clean_text": f"SELECT DISTINCT nullif(regexp_replace(trim(id), '^t[0-9]_', ''), '') AS id, {_clean_sql('body')} AS body_clean FROM comments",
    "prj02_rule_text": f"""WITH r AS (SELECT nullif(regexp_replace(lower(trim(subreddit)), '^/?r/', ''), '') AS sub, unnest(rules) AS r FROM subreddits), t AS (SELECT sub, r.rule_index AS rule_index, {_clean_sql('r.short_name')} AS s, {_clean_sql('r.description')} AS d, {_clean_sql('r.violation_reason')} AS v FROM r)
SELECT DISTINCT sub, rule_index, s AS short_name, trim(CASE WHEN v <> '' THEN 'Violation: ' || v || chr(10) ELSE '' END || 'Rule: ' || rtrim(s, '.') || '. ' || d) AS whole FROM t""",
    "flt04_bots": "SELECT DISTINCT author, coalesce(author, '') = '' OR lower(author) IN ('[removed]', '[deleted]') OR regexp_matches(lower(author), 'bot|automod|modteam|removal|helper|reminder|converter|translator') AS bot FROM comments",
    "scl05_language_root": "SELECT coalesce(split_part(replace(lang, '_', '-'), '-', 1), 'unknown') AS root, count(*) AS n FROM documents GROUP BY 1",
    "scl06_timestamp": "SELECT DISTINCT nullif(regexp_replace(trim(id), '^t[0-9]_', ''), '') AS id, strftime(make_timestamp(created_utc * 1000000), '%a, %b %-d, %Y, %-I:%M%p') AS text FROM submissions",
    "scl07_mentions": "SELECT DISTINCT nullif(regexp_replace(trim(id), '^t[0-9]_', ''), '') AS id, regexp_replace(body_clean, 'u/[\\p{L}\\p{N}_]+', '', 'g') AS text FROM comments WHERE contains(body_clean, 'u/')",
    "scl08_answers": "SELECT doc_id, CASE WHEN regexp_extract(lower(coalesce(text, '')), '[a-z]') <> '' THEN '(' || regexp_extract(lower(coalesce(text, '')), '[a-z]') || ')' ELSE '' END AS choice, coalesce(lower(substr(text, 1, 1)) = 'a', false) AS judged FROM documents",
    "scl09_judged": "SELECT doc_id, coalesce(contains(lower(text), 'a') AND NOT contains(lower(text), 'b') AND NOT contains(lower(text), 'c'), false) AS judged FROM documents",
    "scl12_errors": """WITH m AS (SELECT event_type || ' ' || (event_id % 500)::VARCHAR || CASE WHEN user_id % 5 = 0 THEN ' timeout' ELSE '' END AS t FROM events)
SELECT CASE WHEN contains(t, '404') OR contains(t, 'not found') THEN '404_not_found' WHEN contains(t, '403') OR contains(t, 'forbidden') THEN '403_forbidden' WHEN contains(t, '429') OR contains(t, 'too many') THEN '429_rate_limited' WHEN contains(t, 'timeout') THEN 'timeout' ELSE 'other_error' END AS category, count(*) AS n FROM m GROUP BY 1""",
    "scl13_urls": f"SELECT DISTINCT url, {_URLHOST} AS host, {_URLEXT} AS ext FROM submissions WHERE url IS NOT NULL",
    "flt11_edited": "SELECT id, coalesce(bool_or(present AND NOT off), false) AS edited FROM (SELECT nullif(regexp_replace(trim(id), '^t[0-9]_', ''), '') AS id, list_contains(json_keys(raw), 'edited') AS present, coalesce(json_extract(raw, '$.edited')::VARCHAR = 'false', false) AS off FROM comments) GROUP BY id",
    "tre01_edges": f"WITH RECURSIVE {_LINKS} SELECT id, root, depth::BIGINT AS depth FROM walk WHERE NOT lost",
    "tre06_best_sibling": f"{_NODES} SELECT pair, id AS violating, cand AS compliant, common::BIGINT AS common, length::BIGINT AS length FROM (SELECT *, row_number() OVER (PARTITION BY pair ORDER BY common DESC, length DESC, coalesce(score, 0), cand) AS nth FROM cand) WHERE nth = 1",
    "tre06_candidates": f"{_NODES} SELECT pair, count(*) AS candidates, max(common)::BIGINT AS most_common FROM cand GROUP BY pair",
    "tre04_first_issue": f"{_NODES} SELECT mode, issue, count(*) AS n FROM (SELECT 'violating' AS mode, {_WORD.format('j.v')} AS issue FROM p JOIN j ON j.id = p.violating UNION ALL SELECT 'compliant', {_WORD.format('j.k')} FROM j) GROUP BY 1, 2",
    "tre10_forest": f"WITH RECURSIVE {_LINKS} SELECT n.link, count(*) AS comments, max(w.depth)::BIGINT AS deepest, count(*) FILTER (w.depth = 0) AS roots FROM walk w JOIN node n ON n.id = w.id WHERE NOT w.lost AND n.link IS NOT NULL GROUP BY n.link",
    "mth01_divergence": f"""{_P}, n AS (SELECT sub, rule, count(*) AS n FROM p WHERE rule IS NOT NULL AND sub IS NOT NULL GROUP BY sub, rule), q AS (SELECT sub, n / sum(n) OVER (PARTITION BY sub) AS p, 1.0::DOUBLE / count(*) OVER (PARTITION BY sub) AS u FROM n)
SELECT sub, round(sum(0.5 * p * ln(p / ((p + u) / 2)) + 0.5 * u * ln(u / ((p + u) / 2))), 6) AS divergence FROM q GROUP BY sub""",
    "agg09_floor_percentiles": f"{_P}, n AS (SELECT count(*) AS n FROM p GROUP BY sub), s AS (SELECT list_sort(list(n)) AS v FROM n) SELECT " + ", ".join(f"v[floor(len(v) * {q})::INT + 1] AS {k}" for k, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p95", 0.95))) + " FROM s",
    "agg17_majority": "SELECT doc_id, subject, votes FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY votes DESC, first) AS nth FROM (SELECT doc_id, lower(trim(subject)) AS subject, count(*) AS votes, min(substr(annotator, 2)::INT) AS first FROM subject_labels WHERE subject IS NOT NULL GROUP BY 1, 2)) WHERE nth = 1",
    "win02_filtered_rank": f"{_P}, n AS (SELECT sub, count(*) AS n FROM p WHERE sub IS NOT NULL GROUP BY sub) SELECT sub, n, CASE WHEN n >= 3 THEN row_number() OVER (PARTITION BY n >= 3 ORDER BY n DESC, sub) ELSE 999999 END AS position FROM n",
    "agg16_accuracy": f"""{_P}, {_RES} SELECT CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(split) = 0 THEN 'split' ELSE 'overall' END AS kind, coalesce(label, split, 'all') AS label, round(avg(violating), 6) AS violating, round(avg(compliant), 6) AS compliant, round((avg(violating) + avg(compliant)) / 2, 6) AS overall, count(*) AS pairs
FROM res WHERE violating IS NOT NULL AND compliant IS NOT NULL GROUP BY GROUPING SETS ((), (label), (split))""",
    "mth02_similarity": f"{_SIM} SELECT grp, vec_id, rule, sim FROM sims",
    "match_rules": f"""{_SIM}, t AS (SELECT quantile_cont(sim, 0.95) AS gold, quantile_cont(sim, 0.9) AS amb FROM sims), b AS (SELECT grp, vec_id, count(*) FILTER (sim > amb) AS n, max(sim) AS sim, first(rule ORDER BY sim DESC, rule) AS rule, any_value(gold) AS gold FROM sims, t GROUP BY 1, 2)
SELECT grp, vec_id, CASE WHEN n > 1 THEN 'ambiguous' WHEN sim >= gold THEN 'matched' ELSE 'unmatched' END AS status, CASE WHEN n <= 1 AND sim >= gold THEN rule END AS rule, CASE WHEN n <= 1 AND sim >= gold THEN sim END AS sim FROM b""",
    "spl01_adaptive_split": """WITH x AS (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY sha256(o_custkey::VARCHAR || ':' || o_orderkey::VARCHAR), o_orderkey) AS i FROM orders),
y AS (SELECT *, CASE WHEN n < 10 THEN 1 ELSE greatest(1, round_even(0.1 * n, 0)) END AS t, CASE WHEN n < 3 THEN 0 WHEN n < 10 THEN 1 ELSE greatest(1, round_even(0.1 * n, 0)) END AS v FROM x)
SELECT o_custkey, o_orderkey, CASE WHEN i <= t THEN 'test' WHEN i <= t + v THEN 'val' ELSE 'train' END AS split FROM y""",
    "spl03_options": f"""{_P}, o AS (SELECT DISTINCT nullif(regexp_replace(lower(trim(subreddit)), '^/?r/', ''), '') AS sub, x.short_name_clean AS o FROM (SELECT subreddit, unnest(rules) AS x FROM subreddits) WHERE x.short_name_clean IS NOT NULL)
SELECT pair, (row_number() OVER w - 1)::INT AS pos, '(' || chr(96 + (row_number() OVER w)::INT) || ')' AS label, o AS option FROM p JOIN o USING (sub) WINDOW w AS (PARTITION BY pair ORDER BY sha256(pair || '_v' || o), o)""",
    "doc02_dehydrate": f"WITH {_MEMBER} SELECT pair, side, count(*) AS length, string_agg(id, ',' ORDER BY level, id) AS ids, '[NEEDS_HYDRATION]' AS body FROM m GROUP BY pair, side",
    "doc04_roundtrip": f"WITH {_full('SELECT 1 FROM c', 1).partition('WITH ')[2].rpartition('SELECT 1 FROM c')[0].strip()}, {_MEMBER} SELECT pair, side, count(*) AS length, count(*) FILTER (c.id IS NULL) AS missing, sha256(string_agg(coalesce(c.body_clean, 'missing'), '|' ORDER BY level, m.id)) AS digest FROM m LEFT JOIN (SELECT * FROM c WHERE NOT gone) c ON c.id = m.id GROUP BY pair, side",
}
ORACLE["scl22_prompt"] = f"""{_P}, r AS (SELECT DISTINCT nullif(regexp_replace(lower(trim(subreddit)), '^/?r/', ''), '') AS sub, x.rule_index AS i, x.short_name_clean AS name FROM (SELECT subreddit, unnest(rules) AS x FROM subreddits) WHERE x.short_name_clean IS NOT NULL),
l AS (SELECT sub, string_agg(n || '. ' || name, chr(10) ORDER BY n) AS rules FROM (SELECT sub, name, row_number() OVER (PARTITION BY sub ORDER BY i, name) AS n FROM r) GROUP BY sub),
t AS (SELECT pair, concat_ws(chr(10) || chr(10), 'Community: ' || sub, 'Rules:' || chr(10) || rules, 'Body: ' || rule, 'Discussion:' || chr(10) || concat_ws(chr(10), violating, compliant), 'Which rule is broken?') AS text, strpos(concat_ws(chr(10) || chr(10), 'Community: ' || sub, 'Rules:' || chr(10) || rules, 'Body: ' || rule), 'Body: ') AS spot FROM p JOIN l USING (sub))
SELECT pair, sha256(text) AS digest, CASE WHEN spot > 0 THEN substr(text, 1, spot + 5) ELSE text END AS before FROM t"""
_HERE = (scl01_clean_text, prj02_rule_text, flt04_bots, scl05_language_root, scl06_timestamp, scl07_mentions, scl08_answers, scl09_judged, scl12_errors, scl13_urls, scl17_media, scl19_status, flt11_edited, tre01_edges, tre04_first_issue, tre06_best_sibling, tre06_candidates, tre07_greedy, tre10_forest, mth01_divergence, mth02_similarity, match_rules, agg09_floor_percentiles, agg16_accuracy, agg17_majority, win02_filtered_rank, spl01_adaptive_split, spl03_options, spl04_stratified, spl06_bootstrap, doc02_dehydrate, doc04_roundtrip, scl22_prompt, spl08_least_loaded, mth06_hulls, mth07_colours, ext10_cluster_grid)
QUERIES = {f.__name__: f for f in _HERE}

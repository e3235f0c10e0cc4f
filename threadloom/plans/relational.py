"""Relational queries: one text each, in SQL that Spark and, with a few functions renamed, another engine understand.

A query's text may use the named parts below, which become WITH clauses, and the macros of `_MACROS`.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from ..sources.tables import table

#: macro -> (Spark, DuckDB); {0}, {1} are its arguments.
_MACROS = {
    "BARE": ("nullif(regexp_replace(trim({0}), '^t[0-9]_', ''), '')",) * 2,
    "COMM": ("nullif(regexp_replace(lower(trim({0})), '^/?r/', ''), '')",) * 2,
    "AUTH": ("regexp_replace(lower(trim({0})), '^/?u/', '')",) * 2,
    "UNNEST": ("explode({0})", "unnest({0})"),
    "JSON": ("get_json_object({0}, '$.{1}')", "json_extract_string({0}, '$.{1}')"),
    "KEYS": ("json_object_keys({0})", "json_keys({0})"),
    "SHA": ("sha2({0}, 256)", "sha256({0})"),
    "PCT": ("percentile({0}, {1})", "quantile_cont({0}, {1})"),
    "SET": ("array_join(array_sort(collect_set({0})), ',')", "coalesce(array_to_string(list_sort(list(DISTINCT {0}) FILTER ({0} IS NOT NULL)), ','), '')"),
    "BIG": ("CAST({0} AS BIGINT)",) * 2,
    "DBL": ("CAST({0} AS DOUBLE)",) * 2,
    "TRYBIG": ("try_cast(try_cast({0} AS DOUBLE) AS BIGINT)", "TRY_CAST(TRY_CAST({0} AS DOUBLE) AS BIGINT)"),
    "HAS": ("contains({0}, {1})",) * 2,
    "MONTH": ("date_format({0}, 'yyyy-MM')", "strftime({0}, '%Y-%m')"),
    "EPOCH": ("unix_seconds({0})", "CAST(floor(epoch({0})) AS BIGINT)"),
    "PART": ("split_part({0}, {1}, {2})",) * 2,
    "RX": ("({0} rlike {1})", "regexp_matches({0}, {1})"),
    "RXALL": ("regexp_replace({0}, {1}, {2})", "regexp_replace({0}, {1}, {2}, 'g')"),
    "RXGET": ("regexp_extract({0}, {1}, 1)",) * 2,
    "LEN": ("size({0})", "len({0})"),
    "RINT": ("rint({0})", "round_even({0}, 0)"),
}
_PARTS = {
    "cr": """SELECT BARE(id) AS id, AUTH(author) AS author, body, body_clean, COMM(subreddit) AS sub, BARE(parent_id) AS parent, coalesce(trim(parent_id) LIKE 't3%', false) AS top, BARE(link_id) AS link, distinguished, score, author_flair_text AS flair, raw, created_utc, retrieved_at,
      coalesce(trim(body_clean), '') IN ('', '[removed]', '[deleted]') OR coalesce(author, '[deleted]') IN ('[removed]', '[deleted]') AS gone FROM comments""",
    "c": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY gone, retrieved_at, coalesce(score, -999999), coalesce(author, ''), coalesce(raw, '')) AS nth FROM cr WHERE id IS NOT NULL) z WHERE nth = 1""",
    "sr": "SELECT BARE(id) AS id, author, title, COMM(subreddit) AS sub, created_utc, selftext, url, distinguished, over_18, crosspost_parent, is_self, is_video, link_flair_text AS flair, retrieved_at FROM submissions",
    "s": """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY retrieved_at DESC, coalesce(title, '') DESC, coalesce(selftext, '') DESC, coalesce(author, '') DESC) AS nth FROM sr WHERE id IS NOT NULL) z WHERE nth = 1""",
    "p": """SELECT BARE(mod_comment_id) AS pair, max(COMM(subreddit)) AS sub, max(BARE(submission_id)) AS submission, max(rule) AS rule, max(lower(nullif(trim(rule_cluster_label), ''))) AS label, max(rule_cluster_id) AS cluster_id, max(rule_similarity_score) AS sim, max(BARE(violating_comment_id)) AS violating, max(BARE(compliant_comment_id)) AS compliant,
      max(violating_score) AS vscore, max(compliant_score) AS cscore, max(common_ancestors) AS common, max(violating_depth) AS depth, max(violating_length) AS vlen, max(compliant_length) AS clen, max(lower(nullif(trim(split), ''))) AS split, min(batch_no) AS batch FROM thread_pairs WHERE BARE(mod_comment_id) IS NOT NULL GROUP BY BARE(mod_comment_id)""",
    "d": """SELECT * FROM (SELECT COMM(subreddit) AS sub, title, public_description AS about, lang, language, over18, subscribers, mod_comment_rank AS mrank, mod_comment_count AS n, fetched_at, row_number() OVER (PARTITION BY COMM(subreddit) ORDER BY fetched_at DESC, coalesce(title, ''), coalesce(lang, ''), coalesce(language, ''), coalesce(subscribers, 0), coalesce(mod_comment_count, 0), coalesce(over18, true)) AS nth FROM subreddits) z WHERE nth = 1 AND sub IS NOT NULL""",
    "r": "SELECT DISTINCT sub, x.rule_index AS rule_index, x.short_name AS short_name, x.description AS description, x.violation_reason AS violation_reason, x.short_name_clean AS short_clean, x.description_clean AS desc_clean, x.violation_reason_clean AS viol_clean, x.rule_comprehensive AS whole FROM (SELECT COMM(subreddit) AS sub, UNNEST(rules) AS x FROM subreddits) y WHERE x.rule_index IS NOT NULL",
    # every pair as two answered questions: right where the side's comment has the better score
    "res": "SELECT pair, sub, label, split, CASE WHEN vscore IS NOT NULL AND cscore IS NOT NULL THEN CASE WHEN vscore <= cscore THEN 1 ELSE 0 END END AS violating_ok, CASE WHEN cscore IS NOT NULL THEN CASE WHEN cscore > 0 THEN 1 ELSE 0 END END AS compliant_ok FROM p",
    "side": "SELECT pair, sub, label, split, 'violating' AS side, violating AS comment FROM p UNION ALL SELECT pair, sub, label, split, 'compliant', compliant FROM p",
}

SQL = {
    # --- sources
    "src05_json_fields": "SELECT BARE(id) AS id, JSON(raw, id) AS raw_id, TRYBIG(JSON(raw, controversiality)) AS controversiality FROM comments",
    "src13_present_missing": "SELECT w.submission, s.id IS NOT NULL AS present FROM (SELECT DISTINCT link AS submission FROM c WHERE link IS NOT NULL) w LEFT JOIN s ON w.submission = s.id",
    "src14_date_range": "SELECT MONTH(o_orderdate) AS month, count(*) AS n FROM orders WHERE MONTH(o_orderdate) BETWEEN '1995-03' AND '1996-06' GROUP BY MONTH(o_orderdate)",
    "src17_explode_pairs": "SELECT x.pair, x.side, x.comment, x.sub, coalesce(d.title, '') AS title, coalesce(s.title, '') AS submission_title FROM side x JOIN p ON x.pair = p.pair LEFT JOIN d ON x.sub = d.sub LEFT JOIN s ON p.submission = s.id",
    "src18_latest": "SELECT sub, max_by(id, struct_key) AS id FROM (SELECT sub, id, concat(CASE WHEN title IS NOT NULL THEN '1' ELSE '0' END, lpad(CAST(coalesce(created_utc, 0) AS VARCHAR(12)), 12, '0'), id) AS struct_key FROM s) z GROUP BY sub",
    "src19_path_parts": "SELECT id, PART(url, '/', 3) AS host, PART(url, '/', 4) AS first, PART(url, '/', 5) AS second FROM s WHERE url IS NOT NULL",
    "src21_dimension": "SELECT d.sub, coalesce(d.title, d.sub) AS title, coalesce(d.about, '') AS about, count(r.rule_index) AS rules FROM d LEFT JOIN r ON d.sub = r.sub GROUP BY d.sub, d.title, d.about",
    # --- filters and projections
    "flt01_prefilter": "SELECT BARE(id) AS id, count(*) AS n FROM comments WHERE HAS(raw, '\"edited\":false') AND HAS(raw, '\"controversiality\":1') GROUP BY BARE(id)",
    "flt03_moderator_replies": "SELECT id, parent, sub FROM c WHERE distinguished = 'moderator' AND NOT top AND parent IS NOT NULL",
    "flt05_required_keys": "SELECT BARE(id) AS id, LEN(KEYS(raw)) AS keys, HAS(raw, '\"edited\"') AS has_edited FROM comments WHERE raw IS NOT NULL",
    "flt06_removed": "SELECT gone, count(*) AS n, count(DISTINCT id) AS ids FROM cr GROUP BY gone",
    "flt07_contains_sentinel": "SELECT id, sub FROM s WHERE HAS(coalesce(author, 'None'), '[deleted]') OR HAS(coalesce(author, 'None'), '[removed]') OR HAS(coalesce(selftext, 'None'), '[removed]') OR HAS(coalesce(selftext, 'None'), '[deleted]') OR HAS(coalesce(title, 'None'), '[removed]') OR HAS(coalesce(title, 'None'), '[deleted]')",
    "flt08_author_role": "SELECT id FROM s WHERE coalesce(distinguished, '') NOT IN ('moderator', 'admin')",
    "flt09_cutoff": "SELECT id, coalesce(TRYBIG(created_utc), 0) AS created FROM c WHERE coalesce(TRYBIG(created_utc), 0) < 1427000000",
    "flt10_media": "SELECT id, JSON(raw, media) IS NOT NULL AS has_media FROM c",
    "flt12_has_moderator_child": "SELECT c.id FROM c WHERE EXISTS (SELECT 1 FROM c m WHERE m.parent = c.id AND m.distinguished = 'moderator')",
    "flt13_min_count": "SELECT sub, count(*) AS n FROM c GROUP BY sub HAVING count(*) >= 40",
    "flt14_sfw": "SELECT d.sub FROM d JOIN r ON d.sub = r.sub WHERE coalesce(d.over18, true) = false GROUP BY d.sub HAVING count(*) >= 2",
    "flt15_band": "SELECT sub, count(DISTINCT label) AS clusters FROM p GROUP BY sub HAVING count(DISTINCT label) BETWEEN 2 AND 8 AND max(sim) IS NOT NULL",
    "flt16_both_answered": "SELECT pair FROM res WHERE violating_ok IS NOT NULL AND compliant_ok IS NOT NULL",
    "flt17_english_root": "SELECT sub, lower(PART(replace(language, '_', '-'), '-', 1)) AS root FROM d WHERE lower(PART(replace(language, '_', '-'), '-', 1)) = 'en'",
    "flt18_without_other": "SELECT label, count(*) AS n FROM p WHERE lower(label) <> 'other' GROUP BY label",
    "flt22_enough_matches": "SELECT sub, count(*) AS matched FROM p WHERE rule IS NOT NULL GROUP BY sub HAVING count(*) >= 3",
    "flt23_processing_set": "SELECT DISTINCT p.sub FROM p WHERE p.rule IS NOT NULL AND EXISTS (SELECT 1 FROM c WHERE c.sub = p.sub) AND EXISTS (SELECT 1 FROM s WHERE s.sub = p.sub)",
    "prj04_other_label": "SELECT pair, CASE WHEN label IS NULL OR lower(label) IN ('noise', 'other') THEN 'other' ELSE label END AS label FROM p",
    "scl02_bare_ids": "SELECT DISTINCT BARE(mod_comment_id) AS pair, BARE(submission_id) AS submission, COMM(subreddit) AS sub FROM thread_pairs",
    "scl14_letter_bucket": "SELECT sub, CASE WHEN RX(lower(substr(sub, 1, 1)), '^[a-z0-9]$') THEN lower(substr(sub, 1, 1)) ELSE '_' END AS bucket FROM d",
    "scl25_signed_delta": "SELECT split, round(100 * avg(violating_ok), 1) AS v, round(round(100 * avg(compliant_ok), 1) - round(100 * avg(violating_ok), 1), 1) AS delta FROM res WHERE split IS NOT NULL GROUP BY split",
    "scl29_stable_hash": "SELECT pair, SHA(pair) AS digest FROM p",
    "scl31_json_default": "SELECT event_id, coalesce(BIG(JSON(props, k)), -1) AS k, coalesce(JSON(props, none), 'default') AS other FROM events",
    # --- joins
    "joi01_semi": "SELECT id, sub, link FROM c WHERE EXISTS (SELECT 1 FROM p WHERE p.submission = c.link)",
    "joi02_needed_submissions": "SELECT id, sub FROM s WHERE EXISTS (SELECT 1 FROM p WHERE p.submission = s.id)",
    "joi03_inner": "SELECT p.pair, s.id AS submission FROM p JOIN s ON p.submission = s.id WHERE coalesce(s.author, '[deleted]') <> '[deleted]' AND coalesce(s.selftext, '') <> '[removed]' AND coalesce(s.distinguished, '') NOT IN ('moderator', 'admin')",
    "joi04_parent_reason": "SELECT p.pair, CASE WHEN m.id IS NULL THEN 'moderator comment missing' WHEN v.id IS NULL THEN 'parent missing' WHEN v.link <> m.link THEN 'other submission' ELSE 'found' END AS reason FROM p LEFT JOIN c m ON m.id = p.pair LEFT JOIN c v ON v.id = m.parent",
    "joi05_left_default": "SELECT p.pair, coalesce(r.text, p.rule) AS rule_text FROM p LEFT JOIN (SELECT sub, short_clean, max(whole) AS text FROM r GROUP BY sub, short_clean) r ON r.sub = p.sub AND r.short_clean = p.rule",
    "joi06_strict": "SELECT p.pair, d.sub FROM p JOIN d ON p.sub = d.sub",
    "joi07_explode_key": "SELECT label, sub, row_number() OVER (PARTITION BY sub ORDER BY label DESC) AS nth FROM (SELECT DISTINCT label, sub FROM p WHERE label IS NOT NULL AND sub IS NOT NULL) z",
    "joi09_union_needed": "SELECT n.id, n.splits, c.id IS NOT NULL AS found FROM (SELECT comment AS id, SET(split) AS splits FROM side WHERE comment IS NOT NULL GROUP BY comment) n LEFT JOIN c ON c.id = n.id",
    "joi10_anti_flag": "SELECT p.pair, s.id IS NULL AS source_unavailable FROM p LEFT JOIN s ON p.submission = s.id",
    "joi11_first_match": "SELECT id, EPOCH(min(retrieved_at)) AS first_seen FROM cr WHERE EXISTS (SELECT 1 FROM p WHERE p.violating = cr.id) GROUP BY id",
    "joi14_align_scores": "SELECT p.pair, DBL(r.violating_ok) AS score FROM p LEFT JOIN (SELECT * FROM res WHERE violating_ok IS NOT NULL) r ON r.pair = p.pair WHERE p.split = 'test'",
    "joi15_rekey": "SELECT p.pair, n.label AS new_label, p.label IS DISTINCT FROM n.label AS changed FROM p LEFT JOIN (SELECT rule, max_by(label, concat(lpad(CAST(k AS VARCHAR(9)), 9, '0'), label)) AS label FROM (SELECT rule, label, count(*) AS k FROM p WHERE label IS NOT NULL GROUP BY rule, label) z GROUP BY rule) n ON n.rule = p.rule",
    "joi16_metrics_sizes": "SELECT a.label, a.acc, b.n FROM (SELECT label, round(avg(violating_ok), 6) AS acc FROM res WHERE label IS NOT NULL GROUP BY label) a JOIN (SELECT label, count(*) AS n FROM p GROUP BY label) b ON a.label = b.label WHERE lower(a.label) <> 'other'",
    "joi17_theta": "SELECT a.pack_name AS a, b.pack_name AS b FROM pack_sizes a JOIN pack_sizes b ON a.pack_name < b.pack_name AND a.capacity_tokens * 5 > b.capacity_tokens",
    "joi18_prefix_match": "SELECT s.id, count(*) AS comments FROM s JOIN (SELECT PART(concat(link, '_', id), '_', 1) AS sid FROM c) k ON k.sid = s.id GROUP BY s.id",
    "joi19_enrich": "SELECT x.sub, coalesce(d.title, x.sub) AS title, coalesce(d.about, '') AS about FROM (SELECT DISTINCT sub FROM p) x LEFT JOIN d ON d.sub = x.sub",
    "joi21_ordinal_merge": "SELECT coalesce(a.i, b.i) AS i, a.doc_id AS first, b.doc_id AS second FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM subject_labels WHERE annotator = 'a1') a FULL OUTER JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS i FROM subject_labels WHERE annotator = 'a2') b ON a.i = b.i",
    "joi22_cluster_lookup": "SELECT d.sub, coalesce(k.label, 'Other') AS label, coalesce(k.sim, 0.0) AS sim FROM d LEFT JOIN (SELECT sub, min(label) AS label, max(sim) AS sim FROM p GROUP BY sub) k ON k.sub = d.sub",
    # --- de-duplication
    "ded01_prefer_clean": "SELECT id, gone, coalesce(body_clean, '') AS text FROM c",
    "ded01_counters": "SELECT count_if(gone AND seq = 1) AS removed_first, count_if(NOT gone AND seq > 1 AND before) AS overwritten, count_if(seq > 1) AS repeated FROM (SELECT id, gone, row_number() OVER w AS seq, max(gone) OVER w AS before FROM cr WINDOW w AS (PARTITION BY id ORDER BY retrieved_at, coalesce(score, -999999), gone, coalesce(author, ''), coalesce(raw, ''))) z",
    "ded03_first_and_sets": "SELECT sub, min_by(rule, pair) AS first_rule, SET(split) AS splits, SET(label) AS labels FROM p GROUP BY sub",
    "ded04_by_text": "SELECT whole, min(short_clean) AS short_name, count(DISTINCT sub) AS communities, count(*) AS uses FROM r WHERE whole IS NOT NULL GROUP BY whole",
    "ded05_last_wins": "SELECT id, title, EPOCH(retrieved_at) AS retrieved FROM s",
    "ded06_distinct_submissions": "SELECT DISTINCT coalesce(link, parent) AS submission FROM c WHERE distinguished = 'moderator'",
    # --- aggregates
    "agg01_rank": "SELECT sub, n, row_number() OVER (ORDER BY n DESC, sub) AS position, BIG(sum(n) OVER ()) AS total FROM (SELECT sub, count(*) AS n FROM c WHERE distinguished = 'moderator' GROUP BY sub) z",
    "agg02_zero_fill": "SELECT r.sub, r.short_clean, count(p.pair) AS matches FROM (SELECT DISTINCT sub, short_clean FROM r WHERE short_clean IS NOT NULL) r LEFT JOIN p ON p.sub = r.sub AND p.rule = r.short_clean GROUP BY r.sub, r.short_clean",
    "agg03_match_stats": "SELECT sub, count(*) AS total, count_if(sim >= 0.8) AS matched, count_if(sim < 0.8) AS ambiguous, round(DBL(100) * count_if(sim >= 0.8) / nullif(count(*), 0), 4) AS pct FROM p GROUP BY sub",
    "agg05_top20": "SELECT rule, count(*) AS n FROM p WHERE rule IS NOT NULL GROUP BY rule ORDER BY n DESC, rule LIMIT 20",
    "agg07_percentiles": "SELECT round(PCT(sim, 0.25), 6) AS p25, round(PCT(sim, 0.5), 6) AS p50, round(PCT(sim, 0.75), 6) AS p75, round(PCT(sim, 0.98), 6) AS p98, round(PCT(sim, 0.992), 6) AS p992, round(avg(sim), 6) AS mean FROM p",
    "agg08_histogram": "SELECT BIG(least(99, floor((sim - lo) / (hi - lo) * 100))) AS bin, count(*) AS n FROM (SELECT sim, min(sim) OVER () AS lo, max(sim) OVER () AS hi FROM p WHERE sim IS NOT NULL) z WHERE hi > lo GROUP BY BIG(least(99, floor((sim - lo) / (hi - lo) * 100)))",
    "agg10_buckets": "SELECT b.bucket, count(x.n) AS communities FROM (SELECT '1' AS bucket, 1 AS lo, 1 AS hi UNION ALL SELECT '2-5', 2, 5 UNION ALL SELECT '6-20', 6, 20 UNION ALL SELECT '21-100', 21, 100 UNION ALL SELECT '>100', 101, 1000000000) b LEFT JOIN (SELECT sub, count(*) AS n FROM p GROUP BY sub) x ON x.n BETWEEN b.lo AND b.hi GROUP BY b.bucket",
    "agg11_pass_rate": "SELECT coalesce(sub, 'all') AS sub, round(avg(DBL(CASE WHEN sim >= 0.8 THEN 1 ELSE 0 END)), 6) AS rate FROM p WHERE sub IS NOT NULL GROUP BY GROUPING SETS ((), (sub))",
    "agg12_split_metadata": "SELECT coalesce(split, 'none') AS split, count(DISTINCT sub) AS communities, count(*) AS pairs, count(DISTINCT submission) AS submissions, BIG(sum(coalesce(vlen, 0) + coalesce(clen, 0))) AS comments FROM p GROUP BY coalesce(split, 'none')",
    "agg13_distinct_by_label": "SELECT coalesce(label, 'other') AS label, count(*) AS pairs, count(DISTINCT sub) AS communities, count(DISTINCT concat(sub, '|', rule)) AS rules FROM p GROUP BY coalesce(label, 'other')",
    "agg14_having_threshold": "SELECT root, count(*) AS n, count(DISTINCT p.split) AS splits FROM p JOIN (SELECT sub, lower(PART(replace(language, '_', '-'), '-', 1)) AS root FROM d WHERE language IS NOT NULL) l ON l.sub = p.sub GROUP BY root HAVING count(*) >= 10",
    "agg15_overall": "SELECT round(avg(violating_ok), 6) AS violating, round(avg(compliant_ok), 6) AS compliant, round((avg(violating_ok) + avg(compliant_ok)) / 2, 6) AS overall, count(*) AS pairs FROM res WHERE violating_ok IS NOT NULL AND compliant_ok IS NOT NULL",
    "agg16_grouping_sets": "SELECT CASE WHEN grouping(label) = 0 THEN 'label' WHEN grouping(sub) = 0 THEN 'sub' WHEN grouping(split) = 0 THEN 'split' ELSE 'overall' END AS kind, coalesce(label, sub, split, 'all') AS name, round(avg(violating_ok), 6) AS violating, count(*) AS n FROM (SELECT coalesce(label, 'none') AS label, coalesce(sub, 'none') AS sub, coalesce(split, 'none') AS split, violating_ok FROM res) z GROUP BY GROUPING SETS ((), (label), (sub), (split))",
    "agg18_two_votes": "SELECT sub, SET(rule) AS agreed FROM (SELECT sub, rule, count(*) AS n FROM p WHERE rule IS NOT NULL GROUP BY sub, rule HAVING count(*) >= 2) z GROUP BY sub",
    "agg20_status": "SELECT status, count(*) AS n FROM (SELECT CASE WHEN coalesce(over_18, false) THEN 'skipped_nsfw' WHEN crosspost_parent IS NOT NULL THEN 'skipped_crosspost' WHEN coalesce(is_self, false) THEN 'no_media' ELSE 'wanted' END AS status FROM s) z GROUP BY status",
    "agg21_hydrate_counters": "SELECT coalesce(x.split, 'none') AS split, count_if(c.id IS NOT NULL) AS hydrated, count_if(c.id IS NULL) AS missing FROM side x LEFT JOIN c ON c.id = x.comment GROUP BY coalesce(x.split, 'none')",
    "agg22_cluster_quality": "SELECT count(*) AS clusters, min(n) AS smallest, max(n) AS largest, round(avg(n), 6) AS mean FROM (SELECT label, count(*) AS n FROM embeddings GROUP BY label) z",
    "agg25_label_distribution": "SELECT coalesce(label, 'other') AS label, count(*) AS n FROM p GROUP BY coalesce(label, 'other')",
    "agg26_first_label": "SELECT cluster_id, min_by(label, pair) AS label FROM p WHERE cluster_id IS NOT NULL AND label IS NOT NULL GROUP BY cluster_id",
    "agg27_depths": "SELECT 'length' AS kind, vlen AS k, count(*) AS n FROM p WHERE compliant IS NOT NULL GROUP BY vlen UNION ALL SELECT 'depth', depth, count(*) FROM p WHERE compliant IS NULL OR common IS NULL GROUP BY depth",
    "agg29_language_split": "SELECT CASE WHEN lower(language) LIKE 'en%' THEN 'en' ELSE 'other' END AS lang, count(*) AS communities, BIG(sum(coalesce(n, 0))) AS comments FROM d GROUP BY CASE WHEN lower(language) LIKE 'en%' THEN 'en' ELSE 'other' END",
    "agg30_line_statistics": "SELECT count(*) AS lines, count_if(raw IS NOT NULL) AS parsed, count_if(distinguished = 'moderator') AS matched FROM comments",
    "agg33_sample_distribution": "SELECT coalesce(label, 'other') AS label, count(*) AS n, count(DISTINCT sub) AS communities FROM p WHERE split = 'test' GROUP BY coalesce(label, 'other')",
    # --- ranks and order
    "win03_rank_some": "SELECT sub, CASE WHEN en THEN row_number() OVER (PARTITION BY en ORDER BY coalesce(n, 0) DESC, sub) END AS position FROM (SELECT sub, n, coalesce(lower(language) LIKE 'en%', false) AS en FROM d) z",
    "win06_delta_prev": "SELECT label, split, acc, round(acc - prev, 6) AS delta FROM (SELECT label, split, acc, last_value(acc) OVER (PARTITION BY label ORDER BY split ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM (SELECT label, split, round(avg(violating_ok), 6) AS acc FROM res WHERE label IS NOT NULL AND split IS NOT NULL AND violating_ok IS NOT NULL GROUP BY label, split) z) y",
    "win07_best_flag": "SELECT split, label, acc, abs(acc - max(acc) OVER (PARTITION BY split)) < 0.0001 AS best FROM (SELECT split, label, avg(violating_ok) AS acc0, round(avg(violating_ok), 6) AS acc FROM res WHERE split IS NOT NULL AND label IS NOT NULL AND violating_ok IS NOT NULL GROUP BY split, label) z",
    "win08_dense_renumber": "SELECT cluster_id, CASE WHEN cluster_id = -1 THEN -1 ELSE BIG(dense_rank() OVER (PARTITION BY cluster_id = -1 ORDER BY cluster_id)) END AS renumbered FROM (SELECT DISTINCT cluster_id FROM p WHERE cluster_id IS NOT NULL) z",
    "win09_user_labels": "SELECT link, author, row_number() OVER (PARTITION BY link ORDER BY first, author) AS user_no FROM (SELECT link, author, min(concat(lpad(coalesce(created_utc, '0'), 12, '0'), id)) AS first FROM c WHERE NOT gone AND link IS NOT NULL GROUP BY link, author) z",
    "win11_spearman": "SELECT round(corr(a, b), 6) AS rho, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM (SELECT x, y, rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS a, rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS b FROM (SELECT DBL(count(*)) AS x, avg(violating_ok) AS y FROM res WHERE violating_ok IS NOT NULL AND label IS NOT NULL GROUP BY label) z) w",
    "win12_encoding": "SELECT label, BIG(dense_rank() OVER (ORDER BY label)) - 1 AS code FROM (SELECT DISTINCT label FROM p WHERE label IS NOT NULL) z",
    "srt03_tuple_argmax": "SELECT pair, cand FROM (SELECT p.pair, x.id AS cand, row_number() OVER (PARTITION BY p.pair ORDER BY coalesce(x.score, 0) DESC, length(x.body_clean) DESC, x.id) AS nth FROM p JOIN c v ON v.id = p.violating JOIN c x ON x.parent = v.parent AND x.id <> v.id WHERE NOT x.gone) z WHERE nth = 1",
    "srt05_two_key_topk": "SELECT sub, matched, ambiguous FROM (SELECT sub, count_if(sim >= 0.8) AS matched, count_if(sim < 0.8) AS ambiguous FROM p GROUP BY sub) z ORDER BY matched DESC, ambiguous, sub LIMIT 10",
    # --- sets
    "set01_union_split": "SELECT 'test' AS split, pair FROM p WHERE split = 'test' UNION ALL SELECT 'val', pair FROM p WHERE split = 'val'",
    "set02_except": "SELECT DISTINCT sub FROM c EXCEPT SELECT sub FROM p",
    "set03_intersect": "SELECT sub FROM p WHERE split = 'train' INTERSECT SELECT sub FROM p WHERE split = 'test'",
    "set04_symmetric_difference": "SELECT coalesce(a.sub, b.sub) AS sub, a.sub IS NULL AS only_b FROM (SELECT DISTINCT sub FROM p WHERE split = 'train') a FULL OUTER JOIN (SELECT DISTINCT sub FROM p WHERE split = 'test') b ON a.sub = b.sub WHERE a.sub IS NULL OR b.sub IS NULL",
    "set06_expand_files": "SELECT sub, concat(substr(sub, 1, 1), '/', sub, k.suffix) AS file FROM d CROSS JOIN (SELECT '_comments.zst' AS suffix UNION ALL SELECT '_submissions.zst') k",
    "set07_names": "SELECT DISTINCT COMM(subreddit) AS sub FROM thread_pairs WHERE COMM(subreddit) IS NOT NULL",
    # --- maths
    "mth03_weighted_accuracy": "SELECT label, round((2 * avg(violating_ok) + avg(compliant_ok)) / 3, 6) AS weighted, round(DBL(1) / 3, 6) AS baseline FROM res WHERE violating_ok IS NOT NULL AND compliant_ok IS NOT NULL AND label IS NOT NULL GROUP BY label",
    "mth05_rotation": "SELECT c_custkey, round(c_acctbal * cos(0.5) - c_nationkey * sin(0.5), 4) AS x, round(c_acctbal * sin(0.5) + c_nationkey * cos(0.5), 4) AS y FROM customer",
    "mth10_lengths": "SELECT source, max(length(text)) AS longest, round(avg(length(text)), 4) AS mean FROM documents GROUP BY source",
    # --- splits
    "spl07_batches": "SELECT pair, BIG(floor((row_number() OVER (ORDER BY pair) - 1) / 50)) AS batch FROM p",
    "spl09_round_robin": "SELECT sub, BIG((row_number() OVER (ORDER BY sub) - 1) % 7) AS worker FROM d",
    # --- clusters
    "clu01_grid": "SELECT a.n AS neighbours, b.n AS size FROM (SELECT 5 AS n UNION ALL SELECT 15 UNION ALL SELECT 30) a CROSS JOIN (SELECT 10 AS n UNION ALL SELECT 20) b",
    "clu02_best": "SELECT label, n, spread FROM (SELECT label, count(*) AS n, round(stddev_samp(vec_id), 4) AS spread FROM embeddings GROUP BY label HAVING count(*) BETWEEN 5 AND 500) z ORDER BY n DESC, spread, label LIMIT 10",
    "clu03_noise_label": "SELECT pair, CASE WHEN cluster_id IS NULL OR cluster_id = -1 THEN 'Other' ELSE coalesce(label, 'Other') END AS label FROM p",
    "clu04_merge": "SELECT cluster_id, label, min(cluster_id) OVER (PARTITION BY label) AS merged FROM (SELECT cluster_id, min(label) AS label FROM p WHERE cluster_id IS NOT NULL AND label IS NOT NULL GROUP BY cluster_id) z",
    "clu06_duplicate_labels": "SELECT label, count(DISTINCT cluster_id) AS ids FROM p WHERE label IS NOT NULL GROUP BY label HAVING count(DISTINCT cluster_id) > 1",
    # --- documents and checks
    "doc06_ground_truth": "SELECT doc_id, CASE WHEN max(n) >= 2 THEN 'majority' WHEN count(*) = 1 THEN 'single' ELSE 'none' END AS kind FROM (SELECT doc_id, lower(trim(subject)) AS subject, count(*) AS n FROM subject_labels GROUP BY doc_id, lower(trim(subject))) z GROUP BY doc_id",
    "doc07_metrics": "SELECT label, round(100 * avg(violating_ok), 4) AS acc, count(*) AS n FROM res WHERE label IS NOT NULL AND violating_ok IS NOT NULL GROUP BY label",
    "doc08_results_pivot": "SELECT label, round(avg(CASE WHEN split = 'train' THEN violating_ok END), 6) AS train, round(avg(CASE WHEN split = 'val' THEN violating_ok END), 6) AS val, round(avg(CASE WHEN split = 'test' THEN violating_ok END), 6) AS test FROM res WHERE label IS NOT NULL GROUP BY label",
    "doc09_unpivot": "SELECT label, 'violating' AS metric, round(avg(violating_ok), 6) AS value FROM res WHERE label IS NOT NULL GROUP BY label UNION ALL SELECT label, 'compliant', round(avg(compliant_ok), 6) FROM res WHERE label IS NOT NULL GROUP BY label",
    "val01_sum_of_parts": "SELECT count(*) AS total, count_if(split = 'train') + count_if(split = 'val') + count_if(split = 'test') + count_if(split IS NULL) AS parts FROM p",
    "val02_members_match_lengths": "SELECT p.pair, coalesce(m.n, 0) AS members, p.vlen AS expected, coalesce(m.n, 0) = coalesce(p.vlen, -1) AS ok FROM p LEFT JOIN (SELECT BARE(mod_comment_id) AS pair, count(*) AS n FROM thread_members WHERE side = 'violating' GROUP BY BARE(mod_comment_id)) m ON m.pair = p.pair",
    "val10_expected_rows": "SELECT 'submission' AS kind, p.submission AS id, 'CRITICAL' AS severity FROM p LEFT JOIN s ON s.id = p.submission WHERE s.id IS NULL AND p.submission IS NOT NULL UNION SELECT 'violating', p.violating, 'WARNING' FROM p LEFT JOIN c ON c.id = p.violating WHERE c.id IS NULL AND p.violating IS NOT NULL",
    # --- further sources, filters and projections
    "src15_lookup_any_case": "SELECT x.name, d.sub IS NOT NULL AS found FROM (SELECT DISTINCT display_name AS name, COMM(subreddit) AS key FROM subreddits WHERE display_name IS NOT NULL) x LEFT JOIN d ON d.sub = x.key",
    "src16_index_subset": "SELECT n.sub, n.i FROM (SELECT sub, row_number() OVER (ORDER BY sub) - 1 AS i FROM d) n WHERE EXISTS (SELECT 1 FROM p WHERE p.sub = n.sub)",
    "src20_language_counts": "SELECT coalesce(lower(PART(replace(d.language, '_', '-'), '-', 1)), 'unknown') AS root, p.split, count(*) AS n FROM p JOIN d ON d.sub = p.sub GROUP BY coalesce(lower(PART(replace(d.language, '_', '-'), '-', 1)), 'unknown'), p.split",
    "src22_config_grid": "SELECT g.split, g.label, r.acc FROM (SELECT s.split, l.label FROM (SELECT DISTINCT split FROM p WHERE split IS NOT NULL) s CROSS JOIN (SELECT DISTINCT label FROM p WHERE label IS NOT NULL) l) g LEFT JOIN (SELECT split, label, round(avg(violating_ok), 6) AS acc FROM res WHERE violating_ok IS NOT NULL GROUP BY split, label) r ON r.split = g.split AND r.label = g.label",
    "flt02_moderators": "SELECT id, sub FROM c WHERE distinguished IS NOT DISTINCT FROM 'moderator'",
    "flt19_any_media": "SELECT id, coalesce(is_video, false) OR RX(lower(coalesce(url, '')), '[.](jpg|jpeg|png|gif|webp|bmp)$') AS media FROM s",
    "flt20_parsed": "SELECT BARE(id) AS id FROM comments WHERE JSON(raw, id) IS NOT NULL AND JSON(raw, edited) = 'false'",
    "prj03_without_key": "SELECT pair, sub, submission, split FROM p",
    "scl10_label_clean": "SELECT DISTINCT rule_cluster_label AS raw_label, lower(trim(PART(rule_cluster_label, '/', 1))) AS head FROM thread_pairs WHERE rule_cluster_label IS NOT NULL",
    "scl11_override_lines": "SELECT line, CAST(RXGET(line, '^ *(-?[0-9]+) *:') AS INT) AS id, trim(RXGET(line, ': *(.+)$')) AS label FROM (SELECT concat('  ', CAST(cluster_id AS VARCHAR(9)), ' : ', label) AS line FROM (SELECT DISTINCT cluster_id, label FROM p WHERE cluster_id IS NOT NULL AND label IS NOT NULL) z) y",
    "scl16_url_ampersand": "SELECT id, replace(concat(url, '?a=1&amp;b=2'), '&amp;', '&') AS url FROM s WHERE url IS NOT NULL",
    "scl18_file_name": "SELECT id, concat(id, '_direct.', RXGET(lower(url), '[.]([a-z]+)$')) AS file FROM s WHERE RX(lower(coalesce(url, '')), '[.](jpg|jpeg|png|gif|webp|bmp)$')",
    "scl20_context_flags": "SELECT flags, HAS(flags, 'submission') AS submission, HAS(flags, 'media') AS media, NOT HAS(flags, 'media') OR HAS(flags, 'submission') AS sound FROM (SELECT 'discussion-submission-media' AS flags UNION ALL SELECT 'discussion' UNION ALL SELECT 'discussion-media') z",
    "scl23_before_body": "SELECT id, PART(concat('Title: ', coalesce(title, ''), ' Body: ', coalesce(selftext, '')), 'Body: ', 1) AS head FROM s",
    "scl24_phrase": "SELECT id, concat(replace(title, 'I ', 'We '), CASE WHEN substr(title, length(title), 1) = '.' THEN '' ELSE '.' END) AS phrase FROM s WHERE title IS NOT NULL",
    "scl26_result_path": "SELECT pair, concat_ws('/', 'model', split, sub, pair) AS path FROM p WHERE split IS NOT NULL",
    "scl32_video": "SELECT id, coalesce(is_video, false) OR HAS(lower(coalesce(url, '')), 'youtube.com') AS video FROM s",
    "scl33_fan_out": "SELECT pair, side, concat(side, ': ', coalesce(comment, 'none')) AS message FROM side",
    # --- further joins and aggregates
    "joi20_merge_intervals": "SELECT a.label, a.acc, b.lo, b.hi FROM (SELECT label, round(avg(violating_ok), 6) AS acc FROM res WHERE label IS NOT NULL AND violating_ok IS NOT NULL GROUP BY label) a LEFT JOIN (SELECT label, round(min(vscore), 4) AS lo, round(max(vscore), 4) AS hi FROM p GROUP BY label HAVING count(*) > 5) b ON a.label = b.label",
    "joi23_label_colour": "SELECT p.pair, coalesce(k.colour, 'grey') AS colour FROM p LEFT JOIN (SELECT label, concat('c', CAST(row_number() OVER (ORDER BY label) AS VARCHAR(9))) AS colour FROM (SELECT DISTINCT label FROM p WHERE label IS NOT NULL AND label NOT IN ('other', 'noise')) z) k ON k.label = p.label",
    "ded07_distinct_warnings": "SELECT DISTINCT concat('no rule ', coalesce(p.rule, '(none)'), ' in ', coalesce(p.sub, '(none)')) AS warning FROM p LEFT JOIN r ON r.sub = p.sub AND r.short_clean = p.rule WHERE r.sub IS NULL",
    "agg04_totals": "SELECT count(*) AS pairs, count_if(sim >= 0.8) AS matched, round(DBL(count_if(sim >= 0.8)) / nullif(count(*), 0), 6) AS rate FROM p",
    "agg19_audit": "SELECT coalesce(annotator, 'all') AS annotator, count(*) AS questions, round(avg(ok), 6) AS accuracy FROM (SELECT l.annotator, DBL(CASE WHEN lower(trim(l.subject)) = m.subject THEN 1 ELSE 0 END) AS ok FROM subject_labels l JOIN (SELECT doc_id, min(lower(trim(subject))) AS subject FROM subject_labels GROUP BY doc_id) m ON m.doc_id = l.doc_id WHERE l.annotator IS NOT NULL) z GROUP BY GROUPING SETS ((), (annotator))",
    "agg23_widest": "SELECT split, round(max(hi - lo) / 2, 6) AS half_width, max(best) AS best FROM (SELECT split, label, DBL(max(vscore)) AS hi, DBL(min(vscore)) AS lo, round(avg(violating_ok2), 6) AS best FROM (SELECT split, label, vscore, CASE WHEN vscore > 0 THEN 1 ELSE 0 END AS violating_ok2 FROM p WHERE split IS NOT NULL AND vscore IS NOT NULL) y GROUP BY split, label) z GROUP BY split",
    "agg24_median_centroid": "SELECT c_nationkey, round(PCT(c_acctbal, 0.5), 4) AS y, round(PCT(DBL(c_custkey), 0.5), 4) AS x FROM customer GROUP BY c_nationkey",
    "agg28_by_name": "SELECT COMM(subreddit) AS sub, count(*) AS n FROM comments GROUP BY COMM(subreddit)",
    "agg31_status_by_community": "SELECT sub, count_if(coalesce(over_18, false)) AS skipped, count_if(coalesce(is_self, false)) AS no_media, SET(CASE WHEN coalesce(is_self, false) THEN id END) AS done FROM s GROUP BY sub",
    "agg32_recomputed": "SELECT n.new_label AS label, round(avg(r.violating_ok), 6) AS acc, count(*) AS n FROM res r JOIN (SELECT pair, CASE WHEN label IN ('other', 'noise') OR label IS NULL THEN 'Other' ELSE label END AS new_label FROM p) n ON n.pair = r.pair WHERE r.violating_ok IS NOT NULL GROUP BY n.new_label",
    "win04_rerank": "SELECT sub, row_number() OVER (ORDER BY coalesce(mrank, 999999), sub) AS sfw_rank FROM d WHERE coalesce(over18, true) = false",
    "win10_palette_index": "SELECT label, BIG(floor((row_number() OVER (ORDER BY x, label) - 1) * 9.0 / greatest(count(*) OVER () - 1, 1))) AS colour FROM (SELECT label, min(vec_id) AS x FROM embeddings GROUP BY label) z",
    "srt01_largest_first": "SELECT sub, BIG(sum(length(coalesce(body, '')))) AS size FROM cr GROUP BY sub ORDER BY size DESC, sub LIMIT 20",
    "srt01_all_by_size": "SELECT sub, BIG(sum(length(coalesce(body, '')))) AS size FROM cr GROUP BY sub ORDER BY size DESC, sub",
    "srt06_first_five": "SELECT pair FROM p ORDER BY pair LIMIT 5",
    "srt07_newest_first": "SELECT MONTH(retrieved_at) AS month, count(*) AS n FROM s GROUP BY MONTH(retrieved_at) ORDER BY month DESC LIMIT 12",
    "srt07_all_newest_first": "SELECT MONTH(retrieved_at) AS month, count(*) AS n FROM s GROUP BY MONTH(retrieved_at) ORDER BY month DESC",
    "set05_union_ids": "SELECT violating AS id FROM p WHERE violating IS NOT NULL UNION SELECT compliant FROM p WHERE compliant IS NOT NULL",
    "mth04_slope": "SELECT round(regr_slope(clen, vlen), 6) AS slope, round(regr_intercept(clen, vlen), 6) AS intercept, round(corr(clen, vlen), 6) AS r FROM (SELECT DBL(clen) AS clen, DBL(vlen) AS vlen FROM p WHERE clen IS NOT NULL AND vlen IS NOT NULL) z",
    "mth08_guarded_ratio": "SELECT sub, round(coalesce(DBL(count_if(gone)) / nullif(count_if(NOT gone), 0), 0), 6) AS ratio FROM cr GROUP BY sub",
    "mth09_half_even": "SELECT sub, greatest(BIG(1), BIG(RINT(DBL(count(*)) / 4))) AS share FROM p GROUP BY sub",
    "tre08_pair_metadata": "SELECT p.pair, p.submission, p.rule, round(p.sim, 6) AS sim, p.common, p.depth, p.vlen, p.clen, v.author AS violating_author, k.author AS compliant_author FROM p LEFT JOIN c v ON v.id = p.violating LEFT JOIN c k ON k.id = p.compliant",
    "tre09_adjacency": "SELECT a.sub AS a, SET(b.sub) AS neighbours FROM (SELECT DISTINCT sub, submission FROM p) a JOIN (SELECT DISTINCT sub, submission FROM p) b ON a.submission = b.submission AND a.sub <> b.sub GROUP BY a.sub",
    "clu05_remapped": "SELECT cluster_id, merged, label, CASE WHEN merged = -1 THEN -1 ELSE BIG(dense_rank() OVER (PARTITION BY merged = -1 ORDER BY merged)) END AS renumbered FROM (SELECT cluster_id, label, min(cluster_id) OVER (PARTITION BY label) AS merged FROM (SELECT cluster_id, max(CASE WHEN label LIKE '%spam%' OR label LIKE '%repost%' THEN 'spam' ELSE label END) AS label FROM p WHERE cluster_id IS NOT NULL AND label IS NOT NULL GROUP BY cluster_id) z) y",
    "doc03_thread_ids": "SELECT BARE(mod_comment_id) AS pair, side, count(*) AS length, min(BARE(comment_id)) AS first_id, max(level) AS deepest FROM thread_members GROUP BY BARE(mod_comment_id), side",
    "doc05_media_on_disk": "SELECT s.id, count(m.id) AS on_disk, count(m.id) >= 1 AS skip FROM s LEFT JOIN (SELECT id FROM s WHERE RX(lower(coalesce(url, '')), '[.](jpg|png)$')) m ON m.id = s.id GROUP BY s.id",
    "doc10_language_grid": "SELECT root, round(avg(CASE WHEN split = 'train' THEN violating_ok END), 6) AS train, round(avg(CASE WHEN split = 'test' THEN violating_ok END), 6) AS test FROM (SELECT r.split, r.violating_ok, lower(PART(replace(d.language, '_', '-'), '-', 1)) AS root FROM res r JOIN d ON d.sub = r.sub WHERE d.language IS NOT NULL) z GROUP BY root HAVING count(*) >= 10",
    "doc11_sampling_pool": "SELECT p.pair, coalesce(p.label, 'other') AS label FROM p JOIN d ON d.sub = p.sub WHERE lower(d.language) LIKE 'en%'",
    "val03_orphan_members": "SELECT count(*) AS missing FROM thread_members m LEFT JOIN c ON c.id = BARE(m.comment_id) WHERE c.id IS NULL",
    "val04_duplicate_ids": "SELECT id, count(*) AS copies FROM cr WHERE id IS NOT NULL GROUP BY id HAVING count(*) > 1",
    "val05_unknown_communities": "SELECT DISTINCT c.sub FROM c LEFT JOIN d ON d.sub = c.sub WHERE d.sub IS NULL AND c.sub IS NOT NULL",
    "val06_rules_missing": "SELECT count(*) AS pairs, count_if(r.sub IS NULL) AS without_rule FROM p LEFT JOIN (SELECT DISTINCT sub, short_clean FROM r) r ON r.sub = p.sub AND r.short_clean = p.rule",
    "val07_split_disjoint": "SELECT submission, SET(split) AS splits FROM p WHERE submission IS NOT NULL AND split IS NOT NULL GROUP BY submission HAVING count(DISTINCT split) > 1",
    "val08_levels_dense": "SELECT BARE(mod_comment_id) AS pair, side FROM thread_members GROUP BY BARE(mod_comment_id), side HAVING count(*) <> max(level) + 1",
    "val09_labels_known": "SELECT label, count(DISTINCT cluster_id) AS ids FROM p GROUP BY label",
}


def _expand(text: str, engine: int) -> str:
    """Replaces macros, innermost first."""
    pattern = re.compile(r"\b(" + "|".join(sorted(_MACROS, key=len, reverse=True)) + r")\(")
    while True:
        found = list(pattern.finditer(text))
        if not found:
            return text
        m = found[-1]
        depth, args, start, i, quoted = 1, [], m.end(), m.end(), False
        while depth:
            ch = text[i]
            if ch == "'":
                quoted = not quoted
            elif not quoted:
                depth += (ch == "(") - (ch == ")")
                if (ch == "," and depth == 1) or depth == 0:
                    args.append(text[start:i].strip())
                    start = i + 1
            i += 1
        text = text[: m.start()] + _MACROS[m[1]][engine].format(*args) + text[i:]


def _needs(text: str, seen: dict[str, None]) -> None:
    for name in re.findall(r"(?:FROM|JOIN)\s+(\w+)", text):
        if name in _PARTS and name not in seen:
            _needs(_PARTS[name], seen)
            seen[name] = None


def _full(text: str, engine: int) -> str:
    seen: dict[str, None] = {}
    _needs(text, seen)
    head = f"WITH {', '.join(f'{k} AS ({_PARTS[k]})' for k in seen)}\n" if seen else ""
    return _expand(head + text, engine)


def _query(text: str):
    sql = _full(text, 0)
    names = sorted(set(re.findall(r"(?:FROM|JOIN)\s+(comments|submissions|subreddits|thread_pairs|thread_members|documents|subject_labels|pack_sizes|embeddings|events|orders|customer)\b", sql)))

    def run(spark: SparkSession, folder: str) -> DataFrame:
        for n in names:
            table(spark, folder, n).createOrReplaceTempView(n)
        return spark.sql(sql)

    return run


QUERIES = {k: _query(v) for k, v in SQL.items()}
ORACLE = {k: _full(v, 1) for k, v in SQL.items()}

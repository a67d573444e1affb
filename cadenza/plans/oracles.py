"""SQL for the queries, by name, for DuckDB. Common table expressions are written once and put before the
queries that use them."""

from __future__ import annotations

import re

from cadenza.functions import vocabulary as v
from cadenza.plans.views import lexicon


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower(coalesce({x}, '')), '\([^)]*\)|\[[^\]]*\]', ' ', 'g'), '[^a-z0-9]+', ' ', 'g'))"


def bin_(n: str) -> str:
    return f"CASE WHEN {n} <= 0 THEN '0' WHEN {n} > 100 THEN '100+' ELSE concat(((({n}) - 1) // 10) * 10 + 1, '-', ((({n}) - 1) // 10) * 10 + 10) END"


def words(values) -> str:
    return "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in values) + "]"


def hits(values) -> str:
    return f"len(list_intersect(tokens, {words(values)}))"


def labels(table: dict, key: str, pad: list[str]) -> str:
    """The three best labels of a key by hits, filled up."""
    scored = ", ".join(f"{{'minus': -{hits(w)}, 'label': '{k}'}}" for k, w in table.items() if k in v.ALLOWED[key])
    best = f"list_transform(list_sort(list_filter([{scored}], lambda s: s.minus < 0))[1:3], lambda s: s.label)"
    return f"list_transform([{best}], lambda b: list_concat(b, list_filter({words(pad)}, lambda x: NOT list_contains(b, x)))[1:3])[1]"


def more(a: str, b: str, x: str, y: str, z: str) -> str:
    return f"CASE WHEN {a} > {b} THEN {x} WHEN {b} > {a} THEN {y} ELSE {z} END"


def unit(source: str, key: str) -> str:
    return f"SELECT {key}, feature, value / n AS value FROM (SELECT {key}, feature, value, sqrt(sum(value * value) OVER (PARTITION BY {key})) AS n FROM ({source})) WHERE n > 0"


_LEX = lexicon()
_IN = lambda w: f"len(list_filter(regexp_extract_all(lower(title || ' ' || artist || ' ' || lyrics), '[a-zA-Z][a-zA-Z'']{{2,}}'), lambda x: list_contains({words(w)}, x)))"
_ENTRIES = " UNION ALL ".join(
    (f"SELECT song_id, '{k}:' || x AS feature, {w}::DOUBLE AS value FROM (SELECT song_id, unnest(list_distinct({k})) AS x FROM prof) WHERE x <> 'mixed'" if k in v.LIST_KEYS else f"SELECT song_id, '{k}:' || {k}, {w}::DOUBLE FROM prof WHERE {k} <> 'mixed'")
    for k, w in v.VECTOR_WEIGHTS.items()
)
_MEAN = lambda which: f"SELECT s.case_idx, feature, sum(value) AS value FROM (SELECT case_idx, song_id, rn, max(rn) OVER (PARTITION BY case_idx) AS last FROM seen) s JOIN vec USING (song_id) WHERE {which} GROUP BY s.case_idx, feature"
_BITS = "list_concat(" + ", ".join(
    f"flatten(list_transform(list_filter(list_transform({k if k in v.LIST_KEYS else '[' + k + ']'}, lambda x: replace(x, '_', ' ')), lambda x: x <> 'mixed'), lambda x: [x, '{k} ' || x]))" for k in v.KEYS
) + ")"
_SIM = " + ".join(
    [f"{w} * len(list_intersect(p.{k}, s.{k}))" for k, w in v.OVERLAP_WEIGHTS.items()]
    + [f"CASE WHEN p.{k} <> 'mixed' AND p.{k} = s.{k} THEN {w} ELSE 0 END" for k, w in v.EXACT_WEIGHTS.items()]
    + [f"CASE WHEN list_contains(p.top_keywords, '{k}') AND len(list_intersect(list_concat(s.affect, s.narrative_theme), {words(w)})) > 0 THEN 1 ELSE 0 END" for k, w in v.CROSS.items()]
)

QUOTAS = "(VALUES (0.25, 100, 25), (0.25, 200, 50), (0.25, 300, 75), (0.25, 400, 100), (0.25, 500, 125), (0.5, 100, 50), (0.5, 200, 100), (0.5, 300, 150), (0.5, 400, 200), (0.5, 500, 250), (0.75, 100, 75), (0.75, 200, 150), (0.75, 300, 225), (0.75, 400, 300), (0.75, 500, 375), (1.0, 100, 100), (1.0, 200, 200), (1.0, 300, 300), (1.0, 400, 400), (1.0, 500, 500)) q(ratio, pool, quota)"

#: name -> definition; a definition may use the names before it.
CTES: dict[str, str] = {
    "parts": f"SELECT p_partkey, p_name AS title, p_brand AS artist, p_type, {norm('p_brand')} || '::' || {norm('p_name')} AS song_id FROM part",
    "rows_": "SELECT p_partkey AS ord, song_id, title, artist, text AS lyrics FROM parts JOIN documents ON p_partkey = doc_id",
    "usable": "SELECT * FROM rows_ WHERE length(trim(coalesce(title, ''))) > 0 AND length(trim(coalesce(artist, ''))) > 0 AND length(trim(coalesce(lyrics, ''))) > 0",
    "songs": "SELECT song_id, trim(title, ' ') AS title, trim(artist, ' ') AS artist, trim(lyrics, ' ') AS lyrics FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY ord) AS k FROM usable) WHERE k = 1",
    "tracks": "SELECT o_custkey AS playlist_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_partkey) AS pos, song_id, title, artist, p_type FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN parts ON l_partkey = p_partkey",
    "marked": "SELECT t.*, t.song_id IN (SELECT song_id FROM songs) AS matched FROM tracks t",
    "lists": "SELECT playlist_id, count(*) AS original_track_count, count(*) FILTER (matched) AS matched_song_count, CAST(count(*) FILTER (matched) * 100 // count(*) AS INTEGER) AS matched_coverage_percent FROM marked GROUP BY playlist_id",
    "items": "SELECT playlist_id, song_id, min(pos) AS pos FROM marked WHERE matched GROUP BY playlist_id, song_id",
    "chosen": "SELECT playlist_id, n, row_number() OVER (ORDER BY playlist_id) AS case_idx FROM (SELECT playlist_id, count(*) AS n FROM items GROUP BY playlist_id HAVING count(*) >= 20 ORDER BY playlist_id LIMIT 1000)",
    "split": "SELECT case_idx, playlist_id, song_id, rn, n, rn <= n - least(10, n - 1) AS observed FROM (SELECT case_idx, i.playlist_id, song_id, n, row_number() OVER (PARTITION BY i.playlist_id ORDER BY pos) AS rn FROM items i JOIN chosen c ON i.playlist_id = c.playlist_id)",
    "seen": "SELECT case_idx, song_id, rn FROM split WHERE observed",
    "truth": "SELECT case_idx, song_id FROM split WHERE NOT observed",
    "eval_songs": "SELECT * FROM songs WHERE song_id IN (SELECT song_id FROM split)",
    "pop": "SELECT song_id, count(*) AS pop, min(case_idx * 1000000 + rn) AS first FROM seen GROUP BY song_id",
    "top": "SELECT song_id, pop, row_number() OVER (ORDER BY pop DESC, first) AS pop_rank FROM pop QUALIFY row_number() OVER (ORDER BY pop DESC, first) <= 500",
    "co": "SELECT a.song_id AS src, b.song_id AS dst, count(*) AS n FROM seen a JOIN seen b ON a.case_idx = b.case_idx AND a.song_id <> b.song_id GROUP BY 1, 2",
    "near": "SELECT src, dst, weight, nb_rank FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY round(weight, 9) DESC, dst) AS nb_rank FROM (SELECT src, dst, co.n / sqrt(CAST(a.pop * b.pop AS DOUBLE)) AS weight FROM co JOIN pop a ON a.song_id = src JOIN pop b ON b.song_id = dst)) WHERE nb_rank <= 100",
    "cf": "SELECT case_idx, song_id, cf, touch_rank FROM (SELECT *, row_number() OVER (PARTITION BY case_idx ORDER BY round(cf, 9) DESC, touch) AS touch_rank FROM (SELECT case_idx, dst AS song_id, sum(weight) AS cf, min(rn * 1000 + nb_rank) AS touch FROM seen JOIN near ON src = song_id GROUP BY case_idx, dst) h WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.case_idx = h.case_idx AND s.song_id = h.song_id)) WHERE touch_rank <= 500",
    "cf_ranked": "SELECT case_idx, cf.song_id, row_number() OVER (PARTITION BY case_idx ORDER BY round(cf, 9) DESC, coalesce(pop, 0) DESC, cf.song_id) AS rank FROM cf LEFT JOIN pop ON pop.song_id = cf.song_id",
    "unseen": "SELECT case_idx, song_id, row_number() OVER (PARTITION BY case_idx ORDER BY pop_rank) AS rank FROM (SELECT DISTINCT case_idx FROM split) c, top t WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.case_idx = c.case_idx AND s.song_id = t.song_id)",
    "base": "SELECT case_idx, song_id, place FROM (SELECT case_idx, song_id, row_number() OVER (PARTITION BY case_idx ORDER BY min(spot)) AS place FROM (SELECT case_idx, song_id, rank AS spot FROM cf_ranked UNION ALL SELECT case_idx, song_id, 1000000 + rank FROM unseen) GROUP BY case_idx, song_id) WHERE place <= 500",
    "obs_artists": "SELECT case_idx, artist, count(*) AS n_all, count(*) FILTER (rn > last - 10) AS n_recent FROM (SELECT case_idx, song_id, rn, max(rn) OVER (PARTITION BY case_idx) AS last FROM seen) s JOIN eval_songs e ON e.song_id = s.song_id GROUP BY case_idx, artist",
    "artist": "SELECT case_idx, song_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY case_idx ORDER BY round(score, 9) DESC, pop DESC, song_id) AS rank FROM (SELECT case_idx, e.song_id, coalesce(pop, 0) AS pop, 1000.0::DOUBLE * n_recent + 200.0::DOUBLE * n_all + 0.001::DOUBLE * coalesce(pop, 0) AS score FROM obs_artists o JOIN eval_songs e ON e.artist = o.artist LEFT JOIN pop ON pop.song_id = e.song_id WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.case_idx = o.case_idx AND s.song_id = e.song_id))) WHERE rank <= 500",
    "pool": "SELECT case_idx, song_id, place FROM (SELECT case_idx, song_id, row_number() OVER (PARTITION BY case_idx ORDER BY min(spot)) AS place FROM (SELECT case_idx, song_id, rank AS spot FROM artist WHERE rank <= 125 UNION ALL SELECT case_idx, song_id, 1000000 + place FROM base) GROUP BY case_idx, song_id) WHERE place <= 500",
    "raw_scores": "SELECT p.case_idx, p.song_id, coalesce(cf, 0.0)::DOUBLE AS cf, coalesce(n_all, 0)::DOUBLE AS artist, coalesce(pop, 0)::DOUBLE AS pop FROM pool p LEFT JOIN cf ON cf.case_idx = p.case_idx AND cf.song_id = p.song_id LEFT JOIN eval_songs e ON e.song_id = p.song_id LEFT JOIN obs_artists o ON o.case_idx = p.case_idx AND o.artist = e.artist LEFT JOIN pop ON pop.song_id = p.song_id",
    "prepared": "SELECT case_idx, song_id, cf, artist, pop, "
    + ", ".join(
        f"CASE WHEN max({c}) OVER w <= min({c}) OVER w THEN CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c}_norm"
        for c in ("cf", "artist", "pop")
    )
    + " FROM raw_scores WINDOW w AS (PARTITION BY case_idx)",
    "variants": "SELECT * FROM (VALUES ('CF', 0, 0.35::DOUBLE, 0.0::DOUBLE, 0.0::DOUBLE), ('metadata', 1, 0.0, 0.10, 0.10), ('CF + metadata', 2, 0.35, 0.10, 0.10)) v(variant, spot, w_cf, w_artist, w_pop)",
    "ranked": "SELECT variant, case_idx, song_id, score, row_number() OVER (PARTITION BY variant, case_idx ORDER BY round(score, 9) DESC, song_id) AS rank FROM (SELECT variant, case_idx, song_id, w_artist * artist_norm + w_cf * cf_norm + w_pop * pop_norm AS score FROM prepared, variants)",
    "top10": "SELECT r.variant, r.case_idx, r.song_id, round(r.score, 6) AS score, r.rank, CASE WHEN t.song_id IS NULL THEN 0 ELSE 1 END AS hit FROM ranked r LEFT JOIN truth t ON t.case_idx = r.case_idx AND t.song_id = r.song_id WHERE r.rank <= 10",
    "worded": f"SELECT song_id, title, artist, array_to_string(list_transform(range(0, 12), lambda j: {words(_LEX)}[1 + (ord * 7 + j * (ord % 13 + 3)) % {len(_LEX)}]), ' ') AS lyrics FROM eval_songs JOIN (SELECT song_id, min(ord) AS ord FROM usable GROUP BY song_id) USING (song_id)",
    "tok": f"SELECT song_id, list_distinct(string_split({norm("title || ' ' || lyrics")}, ' ')) AS tokens FROM worded",
    "prof": f"SELECT song_id, {labels(v.EXPANSIONS, 'top_keywords', v.FALLBACK_KEYWORDS)} AS top_keywords, list_transform([{labels(v.AFFECT_WORDS, 'affect', ['mixed'])}], lambda l: CASE WHEN len(list_filter(l, lambda x: x <> 'dramatic')) = 0 THEN ['mixed'] ELSE list_filter(l, lambda x: x <> 'dramatic') END)[1] AS affect, {more(hits(v.EXPANSIONS['high_arousal']), hits(v.EXPANSIONS['low_arousal']), "'high'", "'low'", "'mid'")} AS energy, {more(hits(v.SONG_POSITIVE), hits(v.SONG_NEGATIVE), "'positive'", "'negative'", "'mixed'")} AS valence, {labels(v.GENRE_WORDS, 'genre_style', ['mixed'])} AS genre_style, {labels(v.THEME_WORDS, 'narrative_theme', ['mixed'])} AS narrative_theme, list_transform([list_reverse_sort([{', '.join("{'n': " + hits(w) + f", 'label': '{k}'}}" for k, w in v.CONTEXT_WORDS.items())}])[1]], lambda b: CASE WHEN b.n > 0 THEN b.label ELSE 'mixed' END)[1] AS listening_context, 'mixed' AS cohesion, 'same_vibe' AS next_song_role FROM tok",
    "counted": f"SELECT song_id, lower(artist) AS artist, {_IN(v.LIST_POSITIVE)} AS pos, {_IN(v.LIST_NEGATIVE)} AS neg, {_IN(v.LIST_HIGH)} AS high, {_IN(v.LIST_LOW)} AS low, {_IN(['party', 'dance', 'club'])} AS club FROM worded",
    "votes": "SELECT case_idx, max(n) / sum(n)::DOUBLE AS share, sum(pos) AS pos, sum(neg) AS neg, sum(high) AS high, sum(low) AS low, sum(club) AS club FROM (SELECT case_idx, artist, count(*) AS n, sum(pos) AS pos, sum(neg) AS neg, sum(high) AS high, sum(low) AS low, sum(club) AS club FROM seen JOIN counted USING (song_id) GROUP BY case_idx, artist) GROUP BY case_idx",
    "plist": f"SELECT case_idx, {more('high', 'low', words(['dancefloor', 'high_arousal', 'party']), words(['melancholic_story', 'low_arousal', 'chill']), words(['mixed', 'nostalgic', 'singalong']))} AS top_keywords, [{more('pos', 'neg', "'euphoric'", "'melancholic'", "'mixed'")}] AS affect, {more('high', 'low', "'high'", "'low'", "'mid'")} AS energy, {more('pos', 'neg', "'positive'", "'negative'", "'mixed'")} AS valence, ['mixed'] AS genre_style, [{more('pos', 'neg', "'celebration'", "'heartbreak'", "'mixed'")}] AS narrative_theme, CASE WHEN club > 0 THEN 'party' ELSE 'mixed' END AS listening_context, CASE WHEN share >= 0.5 THEN 'genre' ELSE 'mixed' END AS cohesion, 'same_vibe' AS next_song_role FROM votes",
    "expansions": "SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{w}')" for k, ws in v.EXPANSIONS.items() for w in ws) + ") e(label, word)",
    "plabels": "SELECT DISTINCT case_idx, unnest(list_concat(" + ", ".join(k if k in v.LIST_KEYS else f"[{k}]" for k in v.KEYS) + ")) AS label FROM plist",
    "terms": "SELECT DISTINCT case_idx, term FROM (SELECT case_idx, word AS term FROM plabels JOIN expansions USING (label) UNION ALL SELECT case_idx, replace(label, '_', ' ') FROM plabels WHERE length(label) >= 3 UNION ALL SELECT case_idx, t FROM (SELECT case_idx, unnest(string_split(label, '_')) AS t FROM plabels) WHERE length(t) >= 4)",
    "tindex": f"SELECT song_id, token FROM (SELECT song_id, unnest(list_distinct(string_split({norm("title || ' ' || artist || ' ' || lyrics")}, ' '))) AS token FROM worded) WHERE length(token) >= 3",
    "direct": "SELECT d.case_idx, d.song_id, sum(w) AS score FROM (SELECT case_idx, song_id, (CASE WHEN len(ws) > 1 THEN 2.0 ELSE 1.0 END / len(ws))::DOUBLE AS w FROM (SELECT case_idx, ws, unnest(ws) AS token FROM (SELECT case_idx, list_filter(string_split(term, ' '), lambda t: length(t) >= 3) AS ws FROM terms) WHERE len(ws) > 0) x JOIN tindex USING (token)) d WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.case_idx = d.case_idx AND s.song_id = d.song_id) GROUP BY 1, 2",
    "vec": unit(_ENTRIES, "song_id"),
    "lvec": unit(_MEAN("true"), "case_idx"),
    "svec": unit(_MEAN("rn > last - 8"), "case_idx"),
    "blend": "SELECT *, greatest(0.25, least(0.75, 0.35 + 0.35 * (1 - greatest(0.0, least(1.0, cos)))))::DOUBLE AS alpha FROM (SELECT *, sum(l * s) OVER (PARTITION BY case_idx) AS cos FROM (SELECT coalesce(a.case_idx, b.case_idx) AS case_idx, coalesce(a.feature, b.feature) AS feature, coalesce(a.value, 0) AS l, coalesce(b.value, 0) AS s FROM lvec a FULL JOIN svec b ON a.case_idx = b.case_idx AND a.feature = b.feature))",
    "uvec": unit("SELECT case_idx, feature, (1 - alpha) * l + alpha * s AS value FROM blend", "case_idx"),
    "emo": "SELECT p.case_idx, p.song_id, coalesce(sum(v.value * u.value), 0) AS lemon FROM pool p LEFT JOIN vec v ON v.song_id = p.song_id LEFT JOIN uvec u ON u.case_idx = p.case_idx AND u.feature = v.feature GROUP BY 1, 2",
    "emo_norm": "SELECT case_idx, song_id, CASE WHEN max(lemon) OVER w <= min(lemon) OVER w THEN CASE WHEN lemon > 0 THEN 1.0 ELSE 0.0 END ELSE (lemon - min(lemon) OVER w) / (max(lemon) OVER w - min(lemon) OVER w) END AS lemon_norm FROM emo WINDOW w AS (PARTITION BY case_idx)",
    "ctext": f"SELECT song_id, title || ' ' || artist || ' ' || lyrics || ' ' || array_to_string({_BITS}, ' ') AS text FROM worded JOIN prof USING (song_id)",
    "cwords": "SELECT song_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9_]+')) AS w FROM ctext",
    "cterms": "SELECT song_id, feature, count(*) AS tf FROM (SELECT song_id, unnest(w) AS feature FROM cwords UNION ALL SELECT song_id, w[i] || ' ' || w[i + 1] FROM (SELECT song_id, w, unnest(range(1, len(w))) AS i FROM cwords)) GROUP BY 1, 2",
    "kept": "SELECT feature, count(*) AS df FROM cterms GROUP BY feature ORDER BY sum(tf) DESC, feature LIMIT 6000",
    "tfidf": unit("SELECT song_id, feature, tf * (ln((1 + (SELECT count(*) FROM ctext)) / (1 + df)::DOUBLE) + 1) AS value FROM cterms JOIN kept USING (feature)", "song_id"),
    "cweights": "SELECT case_idx, song_id, CASE WHEN rn > max(rn) OVER (PARTITION BY case_idx) - 10 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM seen",
    "cprofile": "SELECT case_idx, feature, sum(w * value) AS p FROM cweights JOIN tfidf USING (song_id) GROUP BY 1, 2",
    "content": "SELECT *, row_number() OVER (PARTITION BY case_idx ORDER BY round(content, 9) DESC, song_id) AS content_rank FROM (SELECT c.case_idx, c.song_id, s / total AS content FROM (SELECT case_idx, song_id, sum(p * value) AS s FROM cprofile JOIN tfidf USING (feature) GROUP BY 1, 2) c JOIN (SELECT case_idx, sum(w) AS total FROM cweights GROUP BY 1) t ON t.case_idx = c.case_idx WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.case_idx = c.case_idx AND x.song_id = c.song_id)) WHERE content > 0 QUALIFY row_number() OVER (PARTITION BY case_idx ORDER BY round(content, 9) DESC, song_id) <= 500",
    "content_ranked": "SELECT case_idx, c.song_id, row_number() OVER (PARTITION BY case_idx ORDER BY round(content, 9) DESC, coalesce(pop, 0) DESC, c.song_id) AS rank FROM content c LEFT JOIN pop ON pop.song_id = c.song_id",
    "n_true": "SELECT case_idx, count(*) AS n_true, sum(count(*)) OVER () * 0 + (SELECT count(DISTINCT case_idx) FROM split) AS n_cases FROM truth GROUP BY case_idx",
}


def measured(source: str, key: str = "variant") -> str:
    """Metrics at 10 of a ranking (columns: key, case_idx, song_id, rank)."""
    return f"""
SELECT {key}, round(sum(r) / any_value(n_cases), 6) AS recall, round(sum(g) / any_value(n_cases), 6) AS ndcg,
       round((sum(r) / any_value(n_cases) + sum(g) / any_value(n_cases)) / 2, 6) AS proxy FROM (
  SELECT {key}, case_idx, any_value(n_cases) AS n_cases,
         count(*) FILTER (hit) / any_value(n_true)::DOUBLE AS r,
         coalesce(sum(1 / log2(rank + 1)) FILTER (hit), 0) / any_value(ideal) AS g FROM (
    SELECT x.{key}, x.case_idx, x.rank, n_true, n_cases, t.song_id IS NOT NULL AS hit,
           list_sum(list_transform(range(1, least(n_true, 10) + 1), lambda i: 1 / log2(i + 1))) AS ideal
    FROM ({source}) x JOIN n_true n ON n.case_idx = x.case_idx
    LEFT JOIN truth t ON t.case_idx = x.case_idx AND t.song_id = x.song_id WHERE x.rank <= 10)
  GROUP BY {key}, case_idx) GROUP BY {key}"""


_FILTER = {
    "50_50": "matched_song_count >= 50 AND matched_coverage_percent >= 50",
    "50_songs": "matched_song_count >= 50",
    "50_percent": "matched_coverage_percent >= 50",
}


def filtered(which: str) -> str:
    return f"SELECT playlist_id, original_track_count, matched_song_count, matched_coverage_percent, pos, title AS track_name, artist AS artist_name, song_id FROM marked JOIN lists USING (playlist_id) WHERE matched AND {_FILTER[which]}"


def histogram(column: str) -> str:
    return f"SELECT bin, playlists, repeat('#', CAST(round_even(playlists * 48 / max(playlists) OVER (), 0) AS INTEGER)) AS bar FROM (SELECT {bin_(column)} AS bin, count(*) AS playlists FROM lists GROUP BY 1)"


def diversity(artist: str) -> str:
    return f"""
SELECT playlist_id, sum(n_rows)::BIGINT AS input_row_count, arg_max(a, n * 100000 - first) AS top_artist, max(n) AS top_artist_count,
       count(*) AS unique_artist_count, sum(n)::BIGINT AS deduped_track_count, printf('%.6f', max(n) / sum(n)::DOUBLE) AS top_artist_share,
       CAST(max(n) / sum(n)::DOUBLE >= 0.5 AS INTEGER) AS is_artist_dominated,
       CAST(sum(n) >= 20 AND max(n) / sum(n)::DOUBLE <= 0.4 AND count(*) >= 5 AS INTEGER) AS is_diverse
FROM (
  SELECT playlist_id, a, count(*) AS n, min(pos) AS first, sum(k) AS n_rows FROM (
    SELECT playlist_id, song_id, arg_min(lower(trim({artist})), pos) AS a, min(pos) AS pos, count(*) AS k FROM tracks
    WHERE trim(coalesce({artist}, '')) <> '' GROUP BY playlist_id, song_id)
  GROUP BY playlist_id, a)
GROUP BY playlist_id"""


_STEPS = " UNION ALL ".join(
    [f"SELECT 'songs {s}' AS threshold, count(*) FILTER (m >= {s}) AS playlists FROM p" for s in (1, 5, 10, 20, 30, 50, 100)]
    + [f"SELECT 'share {s}', count(*) FILTER (m / n::DOUBLE >= {s}::DOUBLE) FROM p" for s in (0.1, 0.2, 0.3, 0.5, 0.7, 0.9)]
    + ["SELECT 'share 1.0', count(*) FILTER (m = n) FROM p"]
)

BODIES: dict[str, str] = {
    "normalize_keys": "SELECT p_partkey, song_id FROM parts",
    "lyrics_scan_stats": "SELECT count(*) AS n_rows, count(*) FILTER (length(trim(coalesce(title, ''))) > 0) AS has_title, count(*) FILTER (length(trim(coalesce(artist, ''))) > 0) AS has_artist, count(*) FILTER (length(trim(coalesce(lyrics, ''))) > 0) AS has_lyrics, count(*) FILTER (length(trim(coalesce(title, ''))) > 0 AND length(trim(coalesce(artist, ''))) > 0) AS has_title_artist, (SELECT count(*) FROM usable) AS usable_rows, (SELECT count(DISTINCT song_id) FROM usable) AS unique_keys, (SELECT count(*) - count(DISTINCT song_id) FROM usable) AS duplicate_usable_keys FROM rows_",
    "catalog_first_wins": "SELECT song_id, title, artist, md5(lyrics) AS lyrics_md5 FROM songs",
    "catalog_duplicate_keys": "SELECT song_id, count(*) AS n, min(ord) AS first_ord FROM usable GROUP BY song_id HAVING count(*) > 1",
    "coverage_per_playlist": "SELECT * FROM lists",
    "coverage_summary": "SELECT * FROM (SELECT count(*) AS total_playlists, sum(n)::BIGINT AS total_tracks, sum(m)::BIGINT AS matched_tracks, count(*) FILTER (n = 0) AS empty_playlists, count(*) FILTER (n > 0 AND m = n) AS full_playlists, count(*) FILTER (m = 0) AS zero_match_playlists, count(*) FILTER (m > 0 AND m < n) AS partial_playlists FROM (SELECT count(*) AS n, count(*) FILTER (matched AND song_id <> '::') AS m FROM marked GROUP BY playlist_id)), (SELECT count(DISTINCT song_id) AS unique_tracks, count(DISTINCT song_id) FILTER (matched) AS unique_matched_tracks, count(DISTINCT song_id) FILTER (NOT matched) AS unique_missing_tracks FROM marked WHERE song_id <> '::')",
    "coverage_thresholds": f"SELECT * FROM (WITH p AS (SELECT count(*) AS n, count(*) FILTER (matched AND song_id <> '::') AS m FROM marked GROUP BY playlist_id) {_STEPS})",
    "length_histogram": histogram("original_track_count"),
    "matched_histogram": histogram("matched_song_count"),
    **{f"filter_{k}": filtered(k) for k in _FILTER},
    "filter_run_totals": " UNION ALL ".join(f"SELECT '{k}' AS filter, count(*) FILTER ({c}) AS playlists, coalesce(sum(matched_song_count) FILTER ({c}), 0)::BIGINT AS n_rows FROM lists" for k, c in _FILTER.items()),
    "artist_diversity_summary": diversity("artist"),
    "artist_diversity_by_type": diversity("p_type"),
    "artist_diverse_rows": f"SELECT t.playlist_id, pos, song_id, top_artist, top_artist_share, unique_artist_count, deduped_track_count FROM tracks t JOIN ({diversity('artist')}) d ON d.playlist_id = t.playlist_id WHERE is_diverse = 1",
    "case_artist_split": "SELECT case_idx, playlist_id, round(share, 6) AS top_share, unique_artists, round(share, 6) >= 0.5 AS dominated, round(share, 6) <= 0.4 AND unique_artists >= 5 AS diverse FROM (SELECT case_idx, playlist_id, max(n) / sum(n)::DOUBLE AS share, count(*) AS unique_artists FROM (SELECT case_idx, playlist_id, artist, count(*) AS n FROM split JOIN songs USING (song_id) GROUP BY ALL) GROUP BY case_idx, playlist_id)",
    "holdout_split": "SELECT * FROM split",
    "events_session_split": "SELECT playlist_id, song_id, rn, n, rn <= n - least(5, n - 1) AS observed FROM (SELECT user_id AS playlist_id, song_id, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY pos) AS rn FROM (SELECT user_id, song_id, min(pos) AS pos FROM (SELECT user_id, concat_ws(':', event_type, json_extract_string(props, '$.k')) AS song_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events) GROUP BY user_id, song_id)) WHERE n >= 5",
    "eval_ids": "SELECT case_idx AS eval_index, playlist_id, count(*) FILTER (observed) AS observed_count, count(*) FILTER (NOT observed) AS heldout_count FROM split GROUP BY case_idx, playlist_id",
    "popularity_counts": "SELECT song_id, pop FROM pop",
    "popularity_order": "SELECT * FROM top",
    "cooccurrence_counts": "SELECT * FROM co",
    "cf_neighbors": "SELECT src, dst, round(weight, 6) AS weight, nb_rank FROM near",
    "cf_scores_topk": "SELECT case_idx, song_id, round(cf, 6) AS cf, touch_rank FROM cf",
    "cf_pop_pool": "SELECT * FROM base",
    "same_artist_quota": "SELECT case_idx, song_id, round(score, 6) AS score, rank FROM artist WHERE rank <= 125",
    "forced_merge_pool": "SELECT * FROM pool",
    "stage1_recall_grid": f"""
SELECT method, pool, round(sum(hits / n_true::DOUBLE) / any_value(n_cases), 6) AS recall FROM (
  SELECT method, pool, m.case_idx, count(*) AS hits FROM (
    SELECT 'CF + artist' || CAST(CAST(ratio * 100 AS INTEGER) AS VARCHAR) || '% + popularity' AS method, pool, case_idx, song_id FROM (
      SELECT ratio, pool, case_idx, song_id, row_number() OVER (PARTITION BY ratio, pool, case_idx ORDER BY min(spot)) AS place FROM (
        SELECT ratio, pool, case_idx, song_id, rank AS spot FROM artist, {QUOTAS} WHERE rank <= quota
        UNION ALL SELECT ratio, pool, case_idx, song_id, 1000000 + place FROM base, {QUOTAS} WHERE place <= pool)
      GROUP BY ratio, pool, case_idx, song_id) WHERE place <= pool
    UNION ALL SELECT 'Popularity', p, case_idx, song_id FROM unseen, (VALUES (100), (200), (300), (400), (500)) s(p) WHERE rank <= p
    UNION ALL SELECT 'CF', p, case_idx, song_id FROM cf_ranked, (VALUES (100), (200), (300), (400), (500)) s(p) WHERE rank <= p) m
  JOIN truth t ON t.case_idx = m.case_idx AND t.song_id = m.song_id GROUP BY method, pool, m.case_idx) h
JOIN n_true n ON n.case_idx = h.case_idx GROUP BY method, pool""",
    "normalized_scores": "SELECT case_idx, song_id, round(cf_norm, 6) AS cf_norm, round(artist_norm, 6) AS artist_norm, round(pop_norm, 6) AS pop_norm FROM prepared",
    "artist_metadata_score": "SELECT case_idx, song_id, artist::BIGINT AS artist_score FROM prepared",
    "rank_cf_only": "SELECT case_idx, song_id, score, rank, hit FROM top10 WHERE variant = 'CF'",
    "rank_metadata_only": "SELECT case_idx, song_id, score, rank, hit FROM top10 WHERE variant = 'metadata'",
    "rank_fused_top10": "SELECT t.case_idx, t.song_id, score, rank, hit, playlist_id FROM top10 t JOIN chosen c ON c.case_idx = t.case_idx WHERE variant = 'CF + metadata'",
    "metrics_by_variant": measured("SELECT * FROM ranked"),
    "best_variant": f"SELECT variant, recall, ndcg, proxy FROM ({measured('SELECT * FROM ranked')}) JOIN variants USING (variant) ORDER BY proxy DESC, spot LIMIT 1",
    "random_baseline": measured("SELECT 'Random' AS variant, case_idx, song_id, row_number() OVER (PARTITION BY case_idx ORDER BY md5(concat_ws(':', '172', case_idx, song_id))) AS rank FROM pool"),
    "popularity_baseline": measured("SELECT 'Popularity' AS variant, case_idx, song_id, rank FROM unseen"),
    "cold_start_cases": "SELECT s.case_idx, n_observed, coalesce(n_scored, 0) AS n_scored, n_observed <= 1 OR coalesce(n_scored, 0) = 0 AS cold_start FROM (SELECT case_idx, count(*) FILTER (observed) AS n_observed FROM split GROUP BY case_idx) s LEFT JOIN (SELECT case_idx, count(*) AS n_scored FROM cf GROUP BY case_idx) c ON c.case_idx = s.case_idx",
}


_LISTED = lambda key: f"SELECT {key}, " + ", ".join(f"array_to_string({k}, '|') AS {k}" if k in v.LIST_KEYS else k for k in v.KEYS)


def merged(routes: list[str], pool: str) -> str:
    """Two routes in turn, then the third: case_idx, song_id, place."""
    return f"SELECT case_idx, song_id, place FROM (SELECT case_idx, song_id, row_number() OVER (PARTITION BY case_idx ORDER BY min(spot)) AS place FROM (SELECT case_idx, song_id, rank * 2 AS spot FROM {routes[0]} WHERE rank <= {pool} UNION ALL SELECT case_idx, song_id, rank * 2 + 1 FROM {routes[1]} WHERE rank <= {pool} UNION ALL SELECT case_idx, song_id, 1000000 + rank FROM {routes[2]}) GROUP BY case_idx, song_id) WHERE place <= {pool}"


def recall(source: str, keys: str) -> str:
    return f"SELECT {keys}, round(sum(hits / n_true::DOUBLE) / any_value(n_cases), 6) AS recall FROM (SELECT {keys}, m.case_idx, count(*) AS hits FROM ({source}) m JOIN truth t ON t.case_idx = m.case_idx AND t.song_id = m.song_id GROUP BY {keys}, m.case_idx) h JOIN n_true n ON n.case_idx = h.case_idx GROUP BY {keys}"


_HYBRID = " UNION ALL ".join(
    f"SELECT 'Item-CF' AS method, {p} AS pool, case_idx, song_id FROM cf_ranked WHERE rank <= {p} UNION ALL SELECT 'Content', {p}, case_idx, song_id FROM content_ranked WHERE rank <= {p} UNION ALL SELECT 'Hybrid', {p}, case_idx, song_id FROM ({merged(['cf_ranked', 'content_ranked', 'unseen'], str(p))})"
    for p in (100, 200, 300, 400, 500)
)
_LEMON = {"LEMON": (0.0, 0.0, 0.0, 1.0), "CF + LEMON": (0.35, 0.0, 0.0, 0.01), "metadata + LEMON": (0.0, 0.1, 0.1, 0.01), "CF + metadata + LEMON": (0.35, 0.1, 0.1, 0.01)}
_ALL_LABELS = list(dict.fromkeys([*v.ALIASES, *(x for k in v.KEYS for x in v.ALLOWED[k]), "R&B", "Hip Hop", "no such label", ""]))
BODIES |= {
    "song_profile_heuristic": _LISTED("song_id") + " FROM prof",
    "playlist_profile_heuristic": _LISTED("case_idx") + " FROM plist",
    "label_normalization": "SELECT label, key, CASE WHEN w.label IS NULL THEN '' ELSE coalesce(a.normal, '') END AS normal FROM (SELECT unnest(" + words(_ALL_LABELS) + ") AS label) w, (SELECT unnest(" + words(v.KEYS) + ") AS key) k LEFT JOIN (SELECT l.label AS raw, allowed.key AS k, allowed.label AS normal FROM (SELECT unnest(" + words(_ALL_LABELS) + f") AS label) l LEFT JOIN (VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in v.ALIASES.items()) + f") s(alias, target) ON alias = replace({norm('l.label')}, ' ', '_') JOIN (VALUES " + ", ".join(f"('{k}', '{x}')" for k in v.KEYS for x in v.ALLOWED[k]) + f") allowed(key, label) ON allowed.label = coalesce(target, replace({norm('l.label')}, ' ', '_'))) a ON a.raw = w.label AND a.k = k.key",
    "profile_similarity": f"SELECT c.case_idx, c.song_id, coalesce({_SIM}, 0)::DOUBLE AS semantic FROM pool c LEFT JOIN plist p ON p.case_idx = c.case_idx LEFT JOIN prof s ON s.song_id = c.song_id",
    "semantic_terms": "SELECT * FROM terms",
    "token_index": "SELECT * FROM tindex",
    "direct_text_scores": "SELECT case_idx, song_id, round(score, 6) AS score FROM direct",
    "semantic_stage1_recall": recall("SELECT 'CF' AS method, case_idx, song_id FROM base UNION ALL SELECT 'Text', case_idx, song_id FROM (SELECT case_idx, song_id, row_number() OVER (PARTITION BY case_idx ORDER BY min(spot)) AS place FROM (SELECT case_idx, d.song_id, row_number() OVER (PARTITION BY case_idx ORDER BY round(score, 9) DESC, coalesce(pop, 0) DESC, d.song_id) AS spot FROM direct d LEFT JOIN pop ON pop.song_id = d.song_id UNION ALL SELECT case_idx, song_id, 1000000 + rank FROM unseen) GROUP BY case_idx, song_id) WHERE place <= 500", "method"),
    "lemon_song_vectors": "SELECT song_id, feature, round(value, 6) AS value FROM vec",
    "lemon_user_vectors": "SELECT case_idx, feature, round(value, 6) AS value FROM uvec",
    "lemon_alpha": "SELECT round(avg(alpha), 6) AS mean, round(min(alpha), 6) AS low, round(max(alpha), 6) AS high FROM (SELECT case_idx, max(alpha) AS alpha FROM blend GROUP BY case_idx)",
    "lemon_rank": measured("SELECT variant, case_idx, song_id, row_number() OVER (PARTITION BY variant, case_idx ORDER BY round(w0 * cf_norm + w1 * artist_norm + w2 * pop_norm + w3 * lemon_norm, 9) DESC, song_id) AS rank FROM prepared JOIN emo_norm USING (case_idx, song_id), (VALUES " + ", ".join(f"('{k}', {w[0]}::DOUBLE, {w[1]}::DOUBLE, {w[2]}::DOUBLE, {w[3]}::DOUBLE)" for k, w in _LEMON.items()) + ") q(variant, w0, w1, w2, w3)"),
    "tfidf_weights": "SELECT song_id, feature, round(value, 6) AS value FROM tfidf",
    "content_route_topk": "SELECT case_idx, song_id, round(content, 6) AS content, content_rank FROM content",
    "hybrid_pool": merged(["cf_ranked", "content_ranked", "unseen"], "500"),
    "hybrid_recall": recall(_HYBRID, "method, pool"),
    "prompt_text": "SELECT song_id, md5(line) AS line_md5, length(line) AS line_chars FROM (SELECT song_id, '- title: ' || title || '; artist: ' || artist || '; lyrics_excerpt: ' || CASE WHEN length(t) > 240 THEN regexp_replace(t[1:240], ' [^ ]*$', '') ELSE t END AS line FROM (SELECT *, trim(regexp_replace(lyrics, '\\s+', ' ', 'g')) AS t FROM songs))",
    "cache_key_sha1": """SELECT DISTINCT playlist_id, sha1('["fine_keywords_v1", "' || playlist_id || '"]') AS cache_key FROM split""",
}


def with_ctes(body: str) -> str:
    """The body after the definitions that it needs, directly or through others."""
    used: set[str] = set()

    def need(text: str) -> None:
        for name, definition in CTES.items():
            if name not in used and re.search(rf"(?:FROM|JOIN|,)\s+{name}\b", text):
                used.add(name)
                need(definition)

    need(body)
    return "WITH " + ",\n".join(f"{n} AS MATERIALIZED ({d})" for n, d in CTES.items() if n in used) + "\n" + body if used else body


SQL: dict[str, str] = {name: with_ctes(body) for name, body in BODIES.items()}

from cadenza.plans import more_oracles  # noqa: E402, F401  it adds its own

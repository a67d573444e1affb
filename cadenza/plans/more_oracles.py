"""SQL for the queries of `more_queries`, for DuckDB."""

from __future__ import annotations

from cadenza.functions import vocabulary as v
from cadenza.plans.oracles import _LISTED, _SIM, CTES, SQL, measured, merged, norm, recall, unit, with_ctes

CTES |= {
    "sem": f"SELECT c.case_idx, c.song_id, coalesce({_SIM}, 0)::DOUBLE AS semantic FROM pool c LEFT JOIN plist p ON p.case_idx = c.case_idx LEFT JOIN prof s ON s.song_id = c.song_id",
    "sem_norm": "SELECT case_idx, song_id, CASE WHEN max(semantic) OVER w <= min(semantic) OVER w THEN CASE WHEN semantic > 0 THEN 1.0 ELSE 0.0 END ELSE (semantic - min(semantic) OVER w) / (max(semantic) OVER w - min(semantic) OVER w) END AS semantic_norm FROM sem WINDOW w AS (PARTITION BY case_idx)",
    "proute": f"SELECT case_idx, song_id, semantic, row_number() OVER (PARTITION BY case_idx ORDER BY round(semantic, 9) DESC, pop DESC, song_id) AS rank FROM (SELECT p.case_idx, s.song_id, ({_SIM})::DOUBLE AS semantic, coalesce(pop, 0) AS pop FROM plist p CROSS JOIN prof s LEFT JOIN pop ON pop.song_id = s.song_id) x WHERE semantic > 0 AND NOT EXISTS (SELECT 1 FROM seen y WHERE y.case_idx = x.case_idx AND y.song_id = x.song_id) QUALIFY row_number() OVER (PARTITION BY case_idx ORDER BY round(semantic, 9) DESC, pop DESC, song_id) <= 500",
    "text_ranked": "SELECT case_idx, d.song_id, row_number() OVER (PARTITION BY case_idx ORDER BY round(score, 9) DESC, coalesce(pop, 0) DESC, d.song_id) AS rank FROM direct d LEFT JOIN pop ON pop.song_id = d.song_id",
    "circle": "SELECT song_id, row_number() OVER (ORDER BY md5(concat_ws(':', '172', song_id)), song_id) - 1 AS place, count(*) OVER () AS n FROM eval_songs",
    "starts": "SELECT case_idx, ('0x' || substr(md5(concat_ws(':', '172', 'start', case_idx)), 1, 8))::BIGINT AS start FROM (SELECT DISTINCT case_idx FROM split)",
    "scalars": "SELECT p.case_idx, p.song_id, cf_norm AS cf, artist_norm AS artist, pop_norm AS popularity, lemon_norm AS lemon, cf_norm * artist_norm AS cf_artist, cf_norm * pop_norm AS cf_popularity, cf_norm * lemon_norm AS cf_lemon, CASE WHEN t.song_id IS NULL THEN 0 ELSE 1 END AS label FROM prepared p JOIN emo_norm e ON e.case_idx = p.case_idx AND e.song_id = p.song_id LEFT JOIN truth t ON t.case_idx = p.case_idx AND t.song_id = p.song_id",
    "rtext": "SELECT song_id, title || ' ' || artist || ' ' || trim(regexp_replace(lyrics, '\\s+', ' ', 'g')) || ' ' AS text FROM eval_songs",
    "rwords": "SELECT song_id, list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), lambda w: regexp_full_match(w, '[a-z][a-z0-9_]+')) AS w FROM rtext",
    "rterms": "SELECT song_id, feature, count(*) AS tf FROM (SELECT song_id, unnest(w) AS feature FROM rwords UNION ALL SELECT song_id, w[i] || ' ' || w[i + 1] FROM (SELECT song_id, w, unnest(range(1, len(w))) AS i FROM rwords)) GROUP BY 1, 2",
    "rkept": "SELECT feature, count(*) AS df FROM rterms GROUP BY feature ORDER BY sum(tf) DESC, feature LIMIT 6000",
    "rtfidf": unit("SELECT song_id, feature, tf * (ln((1 + (SELECT count(*) FROM rtext)) / (1 + df)::DOUBLE) + 1) AS value FROM rterms JOIN rkept USING (feature)", "song_id"),
    "rweights": "SELECT case_idx, song_id, CASE WHEN rn > max(rn) OVER (PARTITION BY case_idx) - 10 THEN 2.0 ELSE 1.0 END::DOUBLE AS w FROM seen",
    "rprofile": "SELECT case_idx, feature, sum(w * value) AS p FROM rweights JOIN rtfidf USING (song_id) GROUP BY 1, 2",
}
# a label's key stands before the label alone here
CTES["bits"] = (
    "SELECT song_id, list_concat("
    + ", ".join(f"flatten(list_transform(list_filter(list_transform({k if k in v.LIST_KEYS else '[' + k + ']'}, lambda x: replace(x, '_', ' ')), lambda x: x <> 'mixed' AND x <> ''), lambda x: ['{k} ' || x, x]))" for k in v.KEYS)
    + ") AS b FROM prof"
)
CTES["late"] = "SELECT case_idx, song_id, rn FROM (SELECT *, max(rn) OVER (PARTITION BY case_idx) AS last FROM seen) WHERE rn > last - 12"


def reranked(pool: str, score: str, variants: dict[str, tuple[float, float]]) -> str:
    """A ranking of the candidates of `pool` with `score` (case_idx, song_id, cf) and metadata, by variant: the
    weights of the score, and of artist and popularity each."""
    raw = f"SELECT p.case_idx, p.song_id, coalesce(s.cf, 0.0)::DOUBLE AS cf, coalesce(n_all, 0)::DOUBLE AS artist, coalesce(pop, 0)::DOUBLE AS pop FROM ({pool}) p LEFT JOIN ({score}) s ON s.case_idx = p.case_idx AND s.song_id = p.song_id LEFT JOIN eval_songs e ON e.song_id = p.song_id LEFT JOIN obs_artists o ON o.case_idx = p.case_idx AND o.artist = e.artist LEFT JOIN pop ON pop.song_id = p.song_id"
    norms = ", ".join(f"CASE WHEN max({c}) OVER w <= min({c}) OVER w THEN CASE WHEN {c} > 0 THEN 1.0 ELSE 0.0 END ELSE ({c} - min({c}) OVER w) / (max({c}) OVER w - min({c}) OVER w) END AS {c}_norm" for c in ("cf", "artist", "pop"))
    values = ", ".join(f"('{k}', {a}::DOUBLE, {b}::DOUBLE)" for k, (a, b) in variants.items())
    return f"SELECT variant, case_idx, song_id, row_number() OVER (PARTITION BY variant, case_idx ORDER BY round(w_m * artist_norm + w_cf * cf_norm + w_m * pop_norm, 9) DESC, song_id) AS rank FROM (SELECT case_idx, song_id, {norms} FROM ({raw}) WINDOW w AS (PARTITION BY case_idx)), (VALUES {values}) q(variant, w_cf, w_m)"


def filled(first: str) -> str:
    """A route filled up with what is popular."""
    return f"SELECT case_idx, song_id, place FROM (SELECT case_idx, song_id, row_number() OVER (PARTITION BY case_idx ORDER BY min(spot)) AS place FROM (SELECT case_idx, song_id, rank AS spot FROM {first} UNION ALL SELECT case_idx, song_id, 1000000 + rank FROM unseen) GROUP BY case_idx, song_id) WHERE place <= 500"


_SIM_POOL = f"SELECT c.case_idx, c.song_id, coalesce({_SIM}, 0)::DOUBLE AS cf FROM ({filled('proute')}) c LEFT JOIN plist p ON p.case_idx = c.case_idx LEFT JOIN prof s ON s.song_id = c.song_id"
_ROUTES = {
    "CF": ("SELECT * FROM base", "SELECT * FROM cf"),
    "Direct text": (filled("text_ranked"), "SELECT case_idx, song_id, score AS cf FROM direct"),
    "Profile": (filled("proute"), _SIM_POOL),
}
_MODES = {"CF Stage1": filled("cf_ranked"), "Hybrid Stage1": merged(["cf_ranked", "content_ranked", "unseen"], "500")}
_SEMANTIC = {"CF + metadata + semantic": 0.0, "CF + metadata + semantic + LEMON": 0.01}
_ENERGY = "CASE WHEN p_partkey % 3 = 0 THEN 'mid' WHEN p_partkey % 2 = 0 THEN 'high' ELSE 'low' END"
_SCALARS = ("cf", "artist", "popularity", "lemon", "cf_artist", "cf_popularity", "cf_lemon")
_REPORT = {"full_playlists": "total_playlists", "partial_playlists": "total_playlists", "zero_match_playlists": "total_playlists", "matched_tracks": "total_tracks", "unique_matched_tracks": "unique_tracks", "unique_missing_tracks": "unique_tracks"}
_SUMMARY = "SELECT * FROM (SELECT count(*) AS total_playlists, sum(n)::BIGINT AS total_tracks, sum(m)::BIGINT AS matched_tracks, count(*) FILTER (n > 0 AND m = n) AS full_playlists, count(*) FILTER (m = 0) AS zero_match_playlists, count(*) FILTER (m > 0 AND m < n) AS partial_playlists FROM (SELECT count(*) AS n, count(*) FILTER (matched AND song_id <> '::') AS m FROM marked GROUP BY playlist_id)), (SELECT count(DISTINCT song_id) AS unique_tracks, count(DISTINCT song_id) FILTER (matched) AS unique_matched_tracks, count(DISTINCT song_id) FILTER (NOT matched) AS unique_missing_tracks FROM marked WHERE song_id <> '::')"


def whole(sql: str) -> str:
    """The same over every eligible playlist."""
    out = sql.replace(" ORDER BY playlist_id LIMIT 1000)", ")")
    if out == sql:
        raise ValueError("no cap to take away")
    return out


_TOP = lambda source, column, n: f"SELECT case_idx, string_agg({column}, ' ' ORDER BY k) AS x FROM (SELECT case_idx, {column}, row_number() OVER (PARTITION BY case_idx ORDER BY count(*) DESC, {column}) AS k FROM ({source}) GROUP BY case_idx, {column}) WHERE k <= {n} GROUP BY case_idx"

BODIES: dict[str, str] = {
    "cache_last_wins": f"SELECT CAST(p_partkey AS VARCHAR) AS cache_key, {_ENERGY} AS energy, CASE {_ENERGY} WHEN 'mid' THEN 'chill' WHEN 'high' THEN 'euphoric|playful|romantic' ELSE 'dark' END AS affect, 'positive' AS valence FROM part",
    "catalog_of_files": "SELECT song_id, trim(title) AS title, trim(artist) AS artist, md5(lyrics) || ', \"' || ord || '\"' AS lyrics FROM (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY ord) AS k FROM rows_ WHERE length(trim(coalesce(title, ''))) > 0 AND length(trim(coalesce(artist, ''))) > 0) WHERE k = 1",
    "playlist_files_scan": "SELECT playlist_id, pos, song_id, 'Album' AS album FROM marked WHERE matched",
    "playlist_files_first": "SELECT playlist_id, count(*) AS n FROM marked WHERE matched GROUP BY playlist_id ORDER BY playlist_id LIMIT 100",
    "marker_totals": "SELECT count(*) AS files, sum(p)::BIGINT AS playlists, sum(t)::BIGINT AS tracks, sum(m)::BIGINT AS matched, count(*) FILTER (slice < 5) AS skipped, count(*) FILTER (slice >= 5) AS written FROM (SELECT playlist_id // 100 AS slice, count(DISTINCT playlist_id) AS p, count(*) AS t, count(*) FILTER (matched) AS m FROM marked GROUP BY 1)",
    "coverage_report": f"SELECT * FROM (WITH s AS ({_SUMMARY}) " + " UNION ALL ".join(f"SELECT '{k}' AS line, {k} AS n, printf('%.2f%%', CASE WHEN {t} = 0 THEN 0.0 ELSE 100.0::DOUBLE * {k} / {t} END) AS share FROM s" for k, t in _REPORT.items()) + ")",
    "demo_split": "SELECT playlist_id, song_id, rn, n, rn < n AS observed FROM (VALUES ('demo_pop', 'abba::dancing queen', 1, 4), ('demo_pop', 'michael jackson::billie jean', 2, 4), ('demo_pop', 'lady gaga::bad romance', 3, 4), ('demo_pop', 'lady gaga::poker face', 4, 4), ('demo_adele', 'adele::someone like you', 1, 3), ('demo_adele', 'adele::hello', 2, 3), ('demo_adele', 'the beatles::hey jude', 3, 3)) t(playlist_id, song_id, rn, n)",
    "json_profile_extract": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'low' WHEN 2 THEN 'mid' END AS energy, CASE event_id % 5 WHEN 0 THEN 'sad|' || event_type WHEN 1 THEN event_type WHEN 2 THEN 'sad|' || event_type END AS affect, CASE event_id % 5 WHEN 0 THEN 'positive' WHEN 2 THEN 'negative' END AS valence FROM events",
    "profile_assembly": "SELECT song_id, CASE WHEN length(song_id) % 2 = 0 THEN 'chill|dark|' || (SELECT label FROM (VALUES (1, 'mixed')) f(i, label)) ELSE array_to_string(top_keywords, '|') END AS top_keywords, CASE WHEN length(song_id) % 2 = 0 THEN 'low' ELSE energy END AS energy, CASE WHEN length(song_id) % 2 = 0 THEN 'negative' ELSE valence END AS valence FROM prof",
    "cached_song_profiles": f"SELECT r AS run, p.* FROM ({_LISTED('song_id')} FROM prof) p, (VALUES (1), (2)) runs(r)",
    "semantic_norms": "SELECT case_idx, song_id, round(semantic_norm, 6) AS semantic_norm FROM sem_norm",
    "semantic_variants": measured("SELECT variant, case_idx, song_id, row_number() OVER (PARTITION BY variant, case_idx ORDER BY round(0.1::DOUBLE * artist_norm + 0.35::DOUBLE * cf_norm + w * lemon_norm + 0.1::DOUBLE * pop_norm + 0.01::DOUBLE * semantic_norm, 9) DESC, song_id) AS rank FROM prepared JOIN emo_norm USING (case_idx, song_id) JOIN sem_norm USING (case_idx, song_id), (VALUES " + ", ".join(f"('{k}', {w}::DOUBLE)" for k, w in _SEMANTIC.items()) + ") q(variant, w)"),
    "text_fallback_scores": f"SELECT p.case_idx, p.song_id, coalesce(sum(CASE WHEN contains(term, ' ') THEN CASE WHEN contains(x.text, term) THEN 2.0 ELSE 0 END WHEN contains(' ' || x.text || ' ', ' ' || term || ' ') THEN 1.0 ELSE 0 END), 0)::DOUBLE AS score FROM pool p LEFT JOIN terms t ON t.case_idx = p.case_idx LEFT JOIN (SELECT song_id, {norm("title || ' ' || artist || ' ' || lyrics")} AS text FROM worded) x ON x.song_id = p.song_id GROUP BY 1, 2",
    "profile_route_topk": "SELECT case_idx, song_id, round(semantic, 6) AS semantic, rank FROM proute",
    "semantic_rerank": " UNION ALL ".join(
        f"SELECT m.variant, m.recall, m.ndcg, m.proxy, r.recall AS pool_recall FROM ({measured(reranked(pool, score, {name: (0.35, 0.1)}))}) m, ({recall(f'SELECT {chr(39)}{name}{chr(39)} AS route, case_idx, song_id FROM ({pool})', 'route')}) r"
        for name, (pool, score) in _ROUTES.items()
    ),
    "stage1_modes": " UNION ALL ".join(f"SELECT * FROM ({measured(reranked(pool, 'SELECT * FROM cf', {f'{name} x CF': (0.35, 0.0), f'{name} x metadata': (0.0, 0.1), f'{name} x CF + metadata': (0.35, 0.1)}))})" for name, pool in _MODES.items()),
    "random_catalog_ranking": measured("SELECT 'Random catalog' AS variant, case_idx, song_id, row_number() OVER (PARTITION BY case_idx ORDER BY step) AS rank FROM (SELECT a.case_idx, c.song_id, (c.place - a.start % c.n + c.n) % c.n AS step FROM starts a, circle c) x WHERE NOT EXISTS (SELECT 1 FROM seen y WHERE y.case_idx = x.case_idx AND y.song_id = x.song_id)"),
    "token_index_texts": f"SELECT song_id, token FROM (SELECT song_id, unnest(list_distinct(string_split({norm("title || ' ' || artist || ' ' || lyrics")}, ' '))) AS token FROM eval_songs) WHERE length(token) >= 3",
    "tfidf_weights_texts": "SELECT song_id, feature, round(value, 6) AS value FROM rtfidf",
    "content_route_texts": "SELECT case_idx, song_id, round(content, 6) AS content, row_number() OVER (PARTITION BY case_idx ORDER BY round(content, 9) DESC, song_id) AS content_rank FROM (SELECT c.case_idx, c.song_id, s / total AS content FROM (SELECT case_idx, song_id, sum(p * value) AS s FROM rprofile JOIN rtfidf USING (feature) GROUP BY 1, 2) c JOIN (SELECT case_idx, sum(w) AS total FROM rweights GROUP BY 1) t ON t.case_idx = c.case_idx WHERE NOT EXISTS (SELECT 1 FROM seen x WHERE x.case_idx = c.case_idx AND x.song_id = c.song_id)) WHERE content > 0 QUALIFY row_number() OVER (PARTITION BY case_idx ORDER BY round(content, 9) DESC, song_id) <= 500",
    "adapter_scalar_features": "SELECT case_idx, song_id, " + ", ".join(f"round({n}, 6) AS {n}" for n in _SCALARS) + ", label FROM scalars",
    "adapter_scalar_stats": " UNION ALL ".join(f"SELECT '{n}' AS feature, round(avg({n}), 6) AS mean, round(stddev_pop({n}), 6) AS std FROM scalars" for n in _SCALARS),
    "adapter_pairs": "SELECT p.case_idx, p.song_id AS p, j FROM pool p JOIN truth t ON t.case_idx = p.case_idx AND t.song_id = p.song_id, (SELECT unnest(range(1, 21)) AS j) WHERE EXISTS (SELECT 1 FROM pool q WHERE q.case_idx = p.case_idx AND NOT EXISTS (SELECT 1 FROM truth u WHERE u.case_idx = q.case_idx AND u.song_id = q.song_id))",
    "knowledge_texts": (
        "SELECT 'item' AS kind, e.song_id AS id, 'item factual knowledge. title ' || title || '. artist ' || artist || '. semantic tags ' || array_to_string(b, ' ') || '. lyric evidence ' || trim(regexp_replace(lyrics, '\\s+', ' ', 'g'))[1:260] AS text FROM eval_songs e JOIN bits ON bits.song_id = e.song_id"
        " UNION ALL SELECT 'playlist', CAST(n.case_idx AS VARCHAR), 'preference reasoning knowledge. recent observed songs ' || names || '. frequent artists ' || coalesce(a.x, '') || '. long term semantic preferences ' || coalesce(t.x, '') || '. short term semantic intent ' || coalesce(r.x, '') || '.'"
        " FROM (SELECT case_idx, string_agg(title || ' by ' || artist, '; ' ORDER BY rn) AS names FROM late JOIN eval_songs USING (song_id) GROUP BY case_idx) n"
        f" LEFT JOIN ({_TOP('SELECT case_idx, artist FROM seen JOIN eval_songs USING (song_id)', 'artist', 5)}) a ON a.case_idx = n.case_idx"
        f" LEFT JOIN ({_TOP('SELECT case_idx, unnest(b) AS term FROM seen JOIN bits USING (song_id)', 'term', 18)}) t ON t.case_idx = n.case_idx"
        f" LEFT JOIN ({_TOP('SELECT case_idx, unnest(b) AS term FROM late JOIN bits USING (song_id)', 'term', 12)}) r ON r.case_idx = n.case_idx"
    ),
}
_UNCAPPED = ("token_index_texts", "tfidf_weights_texts", "content_route_texts", "adapter_scalar_features", "adapter_scalar_stats", "adapter_pairs", "knowledge_texts")
SQL |= {name: whole(with_ctes(body)) if name in _UNCAPPED else with_ctes(body) for name, body in BODIES.items()}

from cadenza.plans.more_queries import WHOLE  # noqa: E402

SQL |= {f"{name}_whole": whole(SQL[name]) for name in WHOLE}

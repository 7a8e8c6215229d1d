"""The registered queries in DuckDB's SQL, written from the rules rather than from the Spark code."""

from __future__ import annotations

from nabd import fixed_values as fv
from nabd.sources.sample import EVENT_POSTS_SQL, POSTS_SQL, REQUESTS, TABLES

WS = fv.WHITESPACE
NAME = fv.HANDLE_CHARS


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def replace_all(text: str, pattern: str, by: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)}, 'g')"


def collapse(text: str) -> str:
    return f"trim({replace_all(text, f'[{WS}]+', ' ')})"


def strip(text: str) -> str:
    return replace_all(text, f"^[{WS}]+|[{WS}]+$", "")


def table_map(text: str, table: dict) -> str:
    return f"translate({text}, {lit(''.join(table))}, {lit(''.join(table.values()))})"


def search_key(text: str) -> str:
    bare = replace_all(text, r"[\x{064B}-\x{0652}\x{0670}]", "")
    return f"lower({table_map(bare, fv.SEARCH_LETTERS)})"


def no_marks(text: str) -> str:
    return replace_all(text, r"[\x{064B}-\x{065F}\x{0670}\x{0640}]", "")


def digits(text: str) -> str:
    return f"translate({text}, {lit(fv.ARABIC_DIGITS)}, {lit(fv.ASCII_DIGITS)})"


def full_key(text: str) -> str:
    folded = digits(table_map(no_marks(f"nfc_normalize({text})"), fv.FULL_LETTERS))
    return f"lower({collapse(folded)})"


def names(text: str, sign: str, longest: int) -> str:
    found = f"regexp_extract_all({text}, {lit(f'{sign}([{NAME}]{{2,{longest}}})')}, 1)"
    return f"list_sort(list_distinct(list_transform({found}, lambda x: lower(x))))"


RETWEET = f"(?i)^RT[{WS}]+@[\\p{{L}}\\p{{N}}_]+:[{WS}]*"
LINK = f"(?i)https?://[^{WS}]+|www\\.[^{WS}]+"
NOT_KEPT = (
    r"[^\x{0600}-\x{06FF}\x{0750}-\x{077F}a-zA-Z0-9" + WS + r"@#_.,!?\x{061F}\x{060C}\x{061B}:'\x{22}\-]"
)


def clean(text: str, keep_mentions=False, keep_hashtags=True, drop_emojis=True) -> str:
    s = f"regexp_replace({text}, {lit(RETWEET)}, '')"
    s = replace_all(s, LINK, " ")
    s = replace_all(s, f"@([{NAME}]{{2,30}})", r"\1" if keep_mentions else " ")
    if keep_hashtags:
        tag = f"regexp_extract(p, {lit(f'^([{NAME}]{{2,50}})')}, 1)"
        s = (
            f"array_to_string(list_transform(string_split({s}, '#'), lambda p, i: "
            f"CASE WHEN i = 1 THEN p WHEN {tag} = '' THEN '#' || p "
            f"ELSE replace({tag}, '_', ' ') || substr(p, length({tag}) + 1) END), '')"
        )
    else:
        s = replace_all(s, f"#([{NAME}]{{2,50}})", " ")
    if drop_emojis:
        s = replace_all(s, fv.EMOJI, " ")
    for mark in ("!", r"\x{061F}", r"\?", r"\."):
        by = {r"\x{061F}": "؟"}.get(mark, mark.replace("\\", ""))
        s = replace_all(s, f"{mark}{{3,}}", by)
    s = replace_all(s, NOT_KEPT, " ")
    return collapse(f"nfc_normalize({s})")


def rounded(value: str, places: int) -> str:
    return f"CAST(printf('%.{places}f', CAST({value} AS DOUBLE)) AS DOUBLE)"


EVENT_POSTS = f"event_posts AS ({EVENT_POSTS_SQL.format(events='events', customer='customer')})"
POSTS = f"posts AS ({POSTS_SQL.format(**{t: t for t in TABLES})})"
MENTIONED = f"posts_m AS (SELECT *, {names('text', '@', 30)} AS mentions FROM posts)"
NOBODY = "nobody AS (SELECT * REPLACE (CAST(NULL AS VARCHAR) AS user_id, CAST(NULL AS VARCHAR) AS user_handle) FROM posts_m)"
CLEANED = f"cleaned AS (SELECT *, {clean('text')} AS cleaned_text FROM posts_m)"
ANALYSIS_TEXT = "coalesce(nullif(cleaned_text, ''), nullif(text, ''), '')"
VALID_TEST = (
    f"length({strip('body')}) >= 8 AND len(regexp_extract_all(body, {lit(fv.ARABIC_BLOCK)})) >= 3"
)
VALID = f"valid AS (SELECT * FROM (SELECT *, {ANALYSIS_TEXT} AS body FROM cleaned) WHERE {VALID_TEST})"


def hits(words) -> str:
    return " + ".join(f"CAST(contains(lower(body), {lit(w)}) AS INT)" for w in words)


SCORED = f"""scored AS (
  SELECT * , CASE WHEN p > n THEN 'positive' WHEN n > p THEN 'negative' ELSE 'neutral' END AS sentiment,
    CASE WHEN p = n THEN CAST(0.55 AS DOUBLE)
      ELSE least(CAST(0.5 AS DOUBLE) + CAST(0.1 AS DOUBLE) * abs(p - n), CAST(0.95 AS DOUBLE)) END AS score
  FROM (SELECT *, {hits(fv.POSITIVE_WORDS)} AS p, {hits(fv.NEGATIVE_WORDS)} AS n FROM valid))"""
DAY = "TRY_CAST(created_at AS DATE)"
BASE = (POSTS, MENTIONED)
CLEAN_BASE = (*BASE, CLEANED)
SCORED_BASE = (*CLEAN_BASE, VALID, SCORED)


def with_(ctes, query: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n" + query


def _by(keys) -> str:
    return ", ".join(keys)


def _lead(keys) -> str:
    return "".join(f"{k}, " for k in keys)


def _group(keys, *more) -> str:
    columns = [*keys, *more]
    return f" GROUP BY {', '.join(columns)}" if columns else ""


def _over(keys, order: str) -> str:
    part = f"PARTITION BY {_by(keys)} " if keys else ""
    return f"OVER ({part}ORDER BY {order})"


def _match(a: str, b: str, keys) -> str:
    return " AND ".join([f"{a}.{k} IS NOT DISTINCT FROM {b}.{k}" for k in keys]) or "TRUE"


def totals(source: str, keys=()) -> str:
    return f"""SELECT {_lead(keys)}count(*) AS total_posts,
  CASE WHEN count(DISTINCT user_id) = 0 THEN count(*) ELSE count(DISTINCT user_id) END AS total_users,
  CAST(CASE WHEN coalesce(sum(user_followers), 0) = 0
    THEN coalesce(sum(likes) + sum(retweets) + sum(replies), 0) * 10
    ELSE sum(user_followers) END AS BIGINT) AS total_reach
FROM {source}{_group(keys)}"""


def shares(source: str, keys=()) -> str:
    columns = ", ".join(
        rounded(f"100.0 * count(*) FILTER (sentiment = '{c}') / greatest(count(*), 1)", 2)
        + f" AS sentiment_{c}"
        for c in ("positive", "neutral", "negative")
    )
    return f"SELECT {_lead(keys)}{columns} FROM {source}{_group(keys)}"


def timeline(source: str, keys=(), day: str = DAY) -> str:
    counts = ", ".join(
        f"count(*) FILTER (sentiment = '{c}') AS {c}" for c in ("positive", "neutral", "negative")
    )
    return (
        f"SELECT {_lead(keys)}strftime({day}, '%Y-%m-%d') AS day, {counts} FROM {source} "
        f"WHERE {day} IS NOT NULL{_group(keys, day)}"
    )


UID = "coalesce(nullif(user_id, ''), nullif(user_handle, ''))"


def mention_counts(source: str, keys=()) -> str:
    return (
        f"SELECT {_lead(keys)}handle, count(*) AS mentions FROM "
        f"(SELECT {_lead(keys)}unnest(mentions) AS handle FROM {source}){_group(keys, 'handle')}"
    )


def user_stats(source: str, keys=()) -> str:
    return f"""SELECT {_lead(keys)}uid, max_by(handle, post_id) AS handle,
  greatest(coalesce(max(user_followers), 0), 0) AS followers, count(*) AS posts,
  CAST(sum(likes) AS BIGINT) AS likes, CAST(sum(retweets) AS BIGINT) AS retweets,
  CAST(sum(replies) AS BIGINT) AS replies
FROM (SELECT *, {UID} AS uid, coalesce(nullif(user_handle, ''), {UID}) AS handle FROM {source})
WHERE uid IS NOT NULL{_group(keys, 'uid')}"""


def influencers(source: str, keys=(), top: int = 10, extra=()) -> str:
    """Ranked users; groups without any author rank the handles they mention."""
    k = _lead(keys)
    over = f"OVER ({'PARTITION BY ' + _by(keys) if keys else ''})"
    mc = mention_counts(source, keys)
    flags = (
        f"SELECT {k}coalesce(bool_or({UID} IS NOT NULL), false) AS has_users, "
        f"coalesce(bool_or(user_followers > 0), false) AS has_followers FROM {source}{_group(keys)}"
    )
    u_keys = "".join(f"u.{x}, " for x in keys)
    c_keys = "".join(f"c.{x}, " for x in keys)
    c_over = f"OVER ({'PARTITION BY ' + ', '.join('c.' + x for x in keys) if keys else ''})"
    return with_(
        (
            *extra,
            f"mc AS ({mc})",
            f"us AS ({user_stats(source, keys)})",
            f"fl AS ({flags})",
            f"""joined AS (SELECT {u_keys}uid, u.handle, followers, posts, coalesce(mc.mentions, 0) AS m_in,
  (likes + retweets + replies) / greatest(followers, 1) AS rate, has_followers
  FROM us u LEFT JOIN mc ON {_match('u', 'mc', keys)} AND lower(ltrim(u.handle, '@')) = mc.handle
  JOIN fl ON {_match('u', 'fl', keys)})""",
            f"""scored_u AS (SELECT *, followers / greatest(max(followers) {over}, 1) AS f, least(rate, 1.0) AS e,
  posts / greatest(max(posts) {over}, 1) AS p, m_in / greatest(max(m_in) {over}, 1) AS m FROM joined)""",
            f"""both_kinds AS (
  SELECT {k}uid, CASE WHEN handle LIKE '@%' THEN handle ELSE '@' || handle END AS handle, followers,
    {rounded('''least(CAST(1.0 AS DOUBLE), CASE WHEN has_followers
      THEN CAST(0.35 AS DOUBLE) * f + CAST(0.40 AS DOUBLE) * e + CAST(0.15 AS DOUBLE) * p + CAST(0.10 AS DOUBLE) * m
      ELSE CAST(0.50 AS DOUBLE) * p + CAST(0.30 AS DOUBLE) * e + CAST(0.20 AS DOUBLE) * m END)''', 3)} AS influence,
    posts AS total_posts, {rounded('rate', 2)} AS avg_engagement, CAST(0 AS BIGINT) AS by_count FROM scored_u
  UNION ALL
  SELECT {c_keys}c.handle, '@' || c.handle, 0, {rounded(f'c.mentions / max(c.mentions) {c_over}', 3)},
    c.mentions, CAST(0.0 AS DOUBLE), c.mentions FROM mc c JOIN fl ON {_match('c', 'fl', keys)}
  WHERE NOT fl.has_users)""",
            f"""placed AS (SELECT *, CAST(row_number() {_over(keys, 'by_count DESC, influence DESC, uid')} AS INT) AS rank
  FROM both_kinds)""",
        ),
        f"SELECT {k}handle, followers, influence, total_posts, avg_engagement, rank FROM placed WHERE rank <= {top}",
    )


AUTHOR = "nullif(lower(ltrim(coalesce(nullif(user_handle, ''), nullif(user_id, '')), '@')), '')"


def activity(source: str, keys=()) -> str:
    return f"""SELECT {_lead(keys)}handle, count(*) AS activity FROM (
  SELECT {_lead(keys)}{AUTHOR} AS handle FROM {source}
  UNION ALL SELECT {_lead(keys)}unnest(mentions) FROM {source})
WHERE handle IS NOT NULL AND handle <> ''{_group(keys, 'handle')}"""


def author_edges(source: str, keys=()) -> str:
    return f"""SELECT {_lead(keys)}src, dst, count(*) AS weight FROM (
  SELECT {_lead(keys)}{AUTHOR} AS src, unnest(mentions) AS dst FROM {source})
WHERE src IS NOT NULL AND src <> dst{_group(keys, 'src', 'dst')}"""


def all_edges(source: str, keys=()) -> str:
    """Author edges plus co-occurrence edges of author-less posts, each pair counted twice."""
    return f"""SELECT {_lead(keys)}src, dst, CAST(sum(weight) AS BIGINT) AS weight FROM (
  {author_edges(source, keys)}
  UNION ALL
  SELECT {_lead(keys)}a, b, 2 * count(*) FROM (
    SELECT *, unnest(mentions) AS b FROM (
      SELECT {_lead(keys)}mentions, unnest(mentions) AS a FROM {source} WHERE {AUTHOR} IS NULL))
  WHERE a < b{_group(keys, 'a', 'b')}){_group(keys, 'src', 'dst')}"""


def network_ctes(source: str, keys=(), max_nodes=50, max_edges=200) -> tuple:
    k = _lead(keys)
    return (
        f"act AS ({activity(source, keys)})",
        f"""tops AS (SELECT * FROM (SELECT *, CAST(row_number() {_over(keys, 'activity DESC, handle')} AS INT) AS rank
  FROM act) WHERE rank <= {max_nodes})""",
        f"alle AS ({all_edges(source, keys)})",
        f"""tope AS (SELECT * FROM (SELECT e.*, a.rank AS a_rank, b.rank AS b_rank,
  CAST(row_number() OVER ({'PARTITION BY ' + ', '.join('e.' + x for x in keys) + ' ' if keys else ''}ORDER BY weight DESC, src, dst) AS INT) AS rank
  FROM alle e JOIN tops a ON {_match('e', 'a', keys)} AND a.handle = e.src
  JOIN tops b ON {_match('e', 'b', keys)} AND b.handle = e.dst) WHERE rank <= {max_edges})""",
        f"""deg AS (SELECT {k}handle, sum(weight) AS degree FROM (
  SELECT {k}src AS handle, weight FROM tope UNION ALL SELECT {k}dst, weight FROM tope){_group(keys, 'handle')})""",
    )


def node_records(keys=()) -> str:
    k = "".join(f"t.{x}, " for x in keys)
    part = "PARTITION BY " + ", ".join("t." + x for x in keys) if keys else ""
    size = rounded(f"5.0 * t.activity / max(t.activity) OVER ({part})", 0)
    return f"""SELECT {k}t.rank AS rank, CAST(t.rank AS VARCHAR) AS id, '@' || t.handle AS handle,
  greatest(1, CAST({size} AS INT)) AS size,
  CASE WHEN d.degree >= 5 THEN 'influencer' ELSE 'user' END AS "group"
FROM tops t LEFT JOIN deg d ON {_match('t', 'd', keys)} AND d.handle = t.handle"""


def edge_records(keys=()) -> str:
    return (
        f"SELECT {_lead(keys)}rank, CAST(a_rank AS VARCHAR) AS source, "
        "CAST(b_rank AS VARCHAR) AS target, weight FROM tope"
    )


def document(text: str) -> str:
    stops = ", ".join(map(lit, fv.STOP_WORDS))
    tokens = f"regexp_extract_all({full_key(text)}, {lit(fv.TOPIC_TOKEN)})"
    return f"array_to_string(list_filter({tokens}, lambda t: t NOT IN ({stops})), ' ')"


def document_ctes(source: str, text: str, keys=()) -> tuple:
    k = _lead(keys)
    return (
        f"docs AS (SELECT * FROM (SELECT {k}post_id, {document(text)} AS document FROM {source}) WHERE document <> '')",
        f"ws AS (SELECT {k}post_id, regexp_extract_all(document, {lit(fv.WORD)}) AS w FROM docs)",
        f"""grams AS (SELECT {k}post_id, unnest(list_concat(w,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ws)""",
        f"tf AS (SELECT {k}post_id, term, count(*) AS tf FROM grams{_group(keys, 'post_id', 'term')})",
        f"stat AS (SELECT {k}term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM tf{_group(keys, 'term')})",
    )


def phrase_ctes(source: str, text: str, keys=()) -> tuple:
    k = _lead(keys)
    s_keys = "".join(f"s.{x}, " for x in keys)
    t_keys = "".join(f"t.{x}, " for x in keys)
    over = f"OVER ({'PARTITION BY ' + _by(keys) if keys else ''})"
    return (
        *document_ctes(source, text, keys),
        f"""lim AS (SELECT {k}n, CASE WHEN widest >= greatest(2, n // 100) THEN greatest(2, n // 100) ELSE 1 END AS min_df
  FROM (SELECT {k}count(*) AS n FROM docs{_group(keys)}) a
  JOIN (SELECT {k}max(df) AS widest FROM stat{_group(keys)}) b {'USING (' + _by(keys) + ')' if keys else 'ON TRUE'})""",
        f"""voc AS (SELECT {s_keys}s.term, s.df, l.n
  FROM stat s JOIN lim l ON {_match('s', 'l', keys)} WHERE s.df >= l.min_df)""",
        f"""weighted AS (SELECT {t_keys}t.post_id, t.term, t.tf * (ln((1 + v.n) / (1 + v.df)) + 1.0) AS w
  FROM tf t JOIN voc v ON {_match('t', 'v', keys)} AND v.term = t.term)""",
        f"""unit AS (SELECT {k}term, w / sqrt(sum(w * w) OVER (PARTITION BY {_lead(keys)}post_id)) AS u FROM weighted)""",
        f"phrase AS (SELECT {k}term, sum(u) AS score FROM unit{_group(keys, 'term')})",
    )


def topic_ctes(source: str, text: str, keys=(), n_topics=8) -> tuple:
    """Greedy pruning as a walk down the ranked list, one term per step."""
    k = _lead(keys)
    w_keys = "".join(f"w.{x}, " for x in keys)
    return (
        *phrase_ctes(source, text, keys),
        f"""best AS (SELECT * FROM (SELECT {k}term, round(score, 9) AS score,
  row_number() {_over(keys, 'round(score, 9) DESC, term')} AS place FROM phrase) WHERE place <= {3 * n_topics})""",
        f"""walk AS (
  SELECT {k}place, [term] AS chosen, [score] AS scores FROM best WHERE place = 1
  UNION ALL
  SELECT {w_keys}b.place,
    CASE WHEN keep THEN list_append(w.chosen, b.term) ELSE w.chosen END,
    CASE WHEN keep THEN list_append(w.scores, b.score) ELSE w.scores END
  FROM walk w JOIN best b ON {_match('w', 'b', keys)} AND b.place = w.place + 1,
  LATERAL (SELECT len(w.chosen) < {n_topics} AND len(list_filter(w.chosen,
    lambda c: contains(c, b.term) OR contains(b.term, c))) = 0 AS keep) k)""",
        f"final AS (SELECT * FROM walk QUALIFY place = max(place) OVER ({'PARTITION BY ' + _by(keys) if keys else ''}))",
        f"""topic AS (SELECT {k}CAST(i AS INT) AS rank, chosen[i] AS label,
  CAST({rounded('100.0 * scores[i] / CASE WHEN scores[1] = 0 THEN 1 ELSE scores[1] END', 0)} AS INT) AS weight
  FROM (SELECT *, unnest(range(1, len(chosen) + 1)) AS i FROM final))""",
    )


def density_ctes(source: str, key: str, radius: float, least: int) -> tuple:
    """Core points, those they reach, and the nearest core point of the others; `source` has post_id, e."""
    return (
        f"""unit AS (SELECT {key}, post_id, list_transform(d, lambda x: x / sqrt(list_dot_product(d, d))) AS u
  FROM (SELECT {key}, post_id, list_transform(e, lambda x: x::DOUBLE) AS d FROM {source}))""",
        f"""close AS (SELECT a.{key}, a.post_id AS a, b.post_id AS b, list_dot_product(a.u, b.u) AS dot
  FROM unit a JOIN unit b ON a.{key} = b.{key} AND list_dot_product(a.u, b.u) >= 1 - {radius} - 1e-9)""",
        f"core AS MATERIALIZED (SELECT {key}, a FROM close GROUP BY {key}, a HAVING count(*) >= {least})",
        f"""edge AS MATERIALIZED (SELECT c.{key}, c.a, c.b FROM close c JOIN core x ON x.{key} = c.{key} AND x.a = c.a
  JOIN core y ON y.{key} = c.{key} AND y.a = c.b)""",
        f"""reach AS (SELECT {key}, a, a AS b FROM core UNION
  SELECT r.{key}, r.a, e.b FROM reach r JOIN edge e ON e.{key} = r.{key} AND e.a = r.b)""",
        f"part AS (SELECT {key}, a, min(b) AS cluster FROM reach GROUP BY {key}, a)",
        f"""border AS (SELECT c.{key}, c.a, c.b FROM close c JOIN core y ON y.{key} = c.{key} AND y.a = c.b
  WHERE NOT EXISTS (SELECT 1 FROM core x WHERE x.{key} = c.{key} AND x.a = c.a)
  QUALIFY row_number() OVER (PARTITION BY c.{key}, c.a ORDER BY round(c.dot, 12) DESC, c.b) = 1)""",
        f"""clustered AS (SELECT {key}, a AS post_id, cluster FROM part UNION ALL
  SELECT b.{key}, b.a, p.cluster FROM border b JOIN part p ON p.{key} = b.{key} AND p.a = b.b)""",
    )


#: Greedy first-wins over all pairs of posts that share a term, one step per post that has a similar one.
NEAR = (
    f"docs AS (SELECT * FROM (SELECT post_id, {full_key('text')} AS document FROM posts) WHERE document <> '')",
    f"ws AS (SELECT post_id, regexp_extract_all(document, {lit(fv.WORD)}) AS w FROM docs)",
    """grams AS (SELECT post_id, unnest(list_concat(w,
  list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ws)""",
    "tf AS (SELECT post_id, term, count(*) AS tf FROM grams GROUP BY post_id, term)",
    "stat AS (SELECT term, count(*) AS df FROM tf GROUP BY term)",
    """weighted AS (SELECT post_id, term, tf * (ln((1 + n) / (1 + df)) + 1.0) AS w
  FROM tf JOIN stat USING (term), (SELECT count(*) AS n FROM docs))""",
    "unit AS (SELECT post_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY post_id)) AS u FROM weighted)",
    # A pair at 0.92 or more shares one of the terms that hold over 1 - 0.92^2 of the first post's length.
    """heavy AS (SELECT post_id, term FROM (SELECT *, sum(u * u) OVER (PARTITION BY post_id ORDER BY u DESC, term
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM unit) WHERE coalesce(before, 0) <= 0.16)""",
    """candidate AS (SELECT DISTINCT a.post_id AS head, b.post_id FROM heavy a JOIN unit b
  ON a.term = b.term AND a.post_id < b.post_id)""",
    f"""alike AS (SELECT c.head, c.post_id FROM candidate c JOIN unit a ON a.post_id = c.head
  JOIN unit b ON b.post_id = c.post_id AND b.term = a.term
  GROUP BY c.head, c.post_id HAVING round(sum(a.u * b.u), 12) >= {fv.NEAR_THRESHOLD})""",
    """later AS MATERIALIZED (SELECT post_id, list(head) AS heads, row_number() OVER (ORDER BY post_id) AS place
  FROM alike GROUP BY post_id)""",
    """walk AS (SELECT 0::BIGINT AS place, []::BIGINT[] AS gone
  UNION ALL
  SELECT l.place, CASE WHEN len(list_filter(l.heads, lambda h: NOT list_contains(w.gone, h))) > 0
    THEN list_append(w.gone, l.post_id) ELSE w.gone END
  FROM walk w JOIN later l ON l.place = w.place + 1)""",
    "removed AS (SELECT unnest(gone) AS post_id FROM walk WHERE place = (SELECT max(place) FROM walk))",
)


def first_copies(source: str, key: str, where: str = "TRUE") -> str:
    return f"SELECT min(post_id) AS post_id FROM {source} WHERE {where} GROUP BY {key}"


def keyword_test(text: str, keywords) -> str:
    table = str.maketrans(fv.SEARCH_LETTERS) | {ord(c): None for c in fv.SEARCH_MARKS}
    return "(" + " OR ".join(
        f"contains({search_key(text)}, {lit(k.translate(table).lower())})" for k in keywords
    ) + ")"


def in_days(first: str | None, last: str | None) -> str:
    tests = [f"{DAY} >= DATE '{first}'"] if first else []
    tests += [f"{DAY} <= DATE '{last}'"] if last else []
    return f"({DAY} IS NULL OR ({' AND '.join(tests)}))" if tests else "TRUE"


def request_ctes(source: str) -> tuple:
    """Each request on its own: its datasets, its keywords, first copies, its days."""
    parts = []
    for name, keywords, datasets, first, last in REQUESTS:
        tests = [keyword_test("text", keywords)] if keywords else ["TRUE"]
        if datasets:
            tests.append(f"source_dataset IN ({', '.join(map(lit, datasets))})")
        found = (
            f"SELECT * FROM {source} WHERE {' AND '.join(tests)} "
            "QUALIFY row_number() OVER (PARTITION BY text ORDER BY post_id) = 1"
        )
        parts.append(f"SELECT {lit(name)} AS request_id, * FROM ({found}) WHERE {in_days(first, last)}")
    return (f"matched AS ({' UNION ALL '.join(parts)})",)


NATION_REQUESTS = """nreq AS (SELECT concat('n', n_nationkey) AS request_id, [concat('user_', n_nationkey),
  CASE n_nationkey % 3 WHEN 0 THEN 'رائع' WHEN 1 THEN 'le' ELSE 'ing' END] AS kws,
  CASE WHEN n_nationkey % 2 = 0 THEN DATE '2024-01-02' END AS d1,
  CASE WHEN n_nationkey % 4 = 0 THEN DATE '2024-01-25' END AS d2 FROM nation)"""
NATION_PAIRS = f"""npairs AS (SELECT DISTINCT request_id, d1, d2, p.* FROM
  (SELECT *, {search_key('text')} AS sk FROM posts) p
  JOIN (SELECT request_id, d1, d2, unnest(kws) AS kw FROM nreq) r ON contains(p.sk, r.kw))"""
ORDER_KEYWORDS = """okw AS (SELECT concat('o', o_orderkey) AS request_id,
  CASE o_orderkey % 5 WHEN 0 THEN substring('etaoinshrdlu', CAST(1 + o_orderkey % 12 AS INT), 1)
    WHEN 1 THEN substring('theandingionere', CAST(1 + o_orderkey % 13 AS INT), 3)
    WHEN 2 THEN substring('heanrestndou', CAST(1 + o_orderkey % 11 AS INT), 2)
    WHEN 3 THEN concat('user_', o_orderkey % 40) ELSE CAST(o_orderkey AS VARCHAR) END AS kw,
  CASE WHEN o_orderkey % 4 = 0 THEN concat('src', o_orderkey % 8) END AS src FROM orders)"""
ORDER_PAIRS = f"""opairs AS (SELECT k.kw, p.post_id, p.source_dataset FROM
  (SELECT post_id, source_dataset, {search_key('text')} AS sk FROM posts) p
  JOIN (SELECT DISTINCT kw FROM okw) k ON contains(p.sk, k.kw))"""
ORDER_REQUESTS = """oreq AS (SELECT CAST(o_orderkey AS VARCHAR) AS request_id,
  CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS user_id,
  o_orderpriority AS title,
  CASE o_orderstatus WHEN 'O' THEN 'pending' WHEN 'F' THEN 'completed'
    WHEN 'P' THEN CASE WHEN o_orderkey % 2 = 0 THEN 'collecting' END END AS status,
  CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE CAST(o_orderkey % 100 AS INT) END AS progress,
  CASE WHEN o_orderkey % 11 = 0 THEN 'failed before' END AS error_message,
  o_orderdate AS created_at FROM orders)"""


def analysis() -> str:
    keys = ("request_id",)
    values = ", ".join(
        "({}, {})".format(lit(r[0]), "[" + ", ".join(map(lit, r[1])) + "]" if r[1] else "CAST([] AS VARCHAR[])")
        for r in REQUESTS
    )
    quoted = "array_to_string(list_transform(keywords[1:5], lambda k: '\"' || k || '\"'), '، ')"
    tones = fv.TONE_NAMES
    topic_text = (
        "CASE WHEN len(labels) = 0 THEN '' WHEN len(labels) = 1 THEN labels[1] ELSE "
        "array_to_string(labels[1:len(labels) - 1], '، ') || ' و' || labels[len(labels)] END"
    )

    def fill(template, **parts):
        for name, sql in parts.items():
            template = template.replace("{" + name + "}", f"' || {sql} || '")
        return "'" + template + "'"

    def one(value):
        return f"printf('%.1f', {value})"

    negative_text = fv.ADVICE_NEGATIVE.replace("'", "''")
    few = fill(fv.ERROR_TOO_FEW, posts="CAST(total_posts AS VARCHAR)", minimum="'20'")
    inner = influencers("enriched", keys, 10)
    inner = "infl AS (" + inner + ")"
    listing = {
        "top_topics": ("topic", "label || '|' || weight", "label"),
        "top_influencers": ("infl", "handle || '|' || followers || '|' || total_posts", None),
        "network_nodes": ("nrec", "id || '|' || handle || '|' || size || '|' || \"group\"", None),
        "network_edges": ("erec", "source || '|' || target || '|' || weight", None),
    }
    lists = [
        f"l_{name} AS (SELECT request_id, string_agg({item}, ';' ORDER BY rank) AS v FROM {frame} GROUP BY request_id)"
        for name, (frame, item, _) in listing.items()
    ]
    dated = timeline("enriched", keys)
    lists.append(
        f"""l_sentiment_timeline AS (SELECT request_id, count(*) AS n,
  string_agg(day || '|' || positive || '|' || neutral || '|' || negative, ';' ORDER BY day) AS v
  FROM ({dated}) GROUP BY request_id)"""
    )
    columns = ", ".join(
        f"coalesce(l_{c}.v, '') AS {c}" for c in [*listing, "sentiment_timeline"]
    )
    joins = " ".join(
        f"LEFT JOIN l_{c} ON l_{c}.request_id = q.request_id" for c in [*listing, "sentiment_timeline"]
    )
    facts = f"""facts AS (SELECT q.request_id, q.keywords,
  coalesce(t.total_posts, 0) AS total_posts, coalesce(t.total_users, 0) AS total_users,
  coalesce(t.total_reach, 0) AS total_reach,
  coalesce(s.sentiment_positive, 0.0) AS sentiment_positive, coalesce(s.sentiment_neutral, 0.0) AS sentiment_neutral,
  coalesce(s.sentiment_negative, 0.0) AS sentiment_negative, {columns},
  coalesce(l_sentiment_timeline.n, 0) AS days,
  coalesce((SELECT list(label ORDER BY rank) FROM topic x WHERE x.request_id = q.request_id), []) AS all_labels,
  coalesce((SELECT list(handle ORDER BY rank) FROM infl x WHERE x.request_id = q.request_id), []) AS handles,
  (SELECT influence FROM infl x WHERE x.request_id = q.request_id AND rank = 1) AS best_influence
  FROM q LEFT JOIN tot t ON t.request_id = q.request_id LEFT JOIN sh s ON s.request_id = q.request_id {joins})"""
    pos, neu, neg = "sentiment_positive", "sentiment_neutral", "sentiment_negative"
    tone = (
        f"CASE WHEN {pos} >= {neu} AND {pos} >= {neg} THEN {lit(tones['positive'])} "
        f"WHEN {neu} >= {neg} THEN {lit(tones['neutral'])} ELSE {lit(tones['negative'])} END"
    )
    summary = f"""CASE WHEN total_posts = 0 THEN {lit(fv.SUMMARY_EMPTY)} ELSE concat_ws(' ',
  {fill(fv.SUMMARY_COUNTS, posts="format('{:,}', total_posts)", users="format('{:,}', total_users)",
        keywords=f"CASE WHEN len(keywords) > 0 THEN {quoted} ELSE {lit(fv.SUMMARY_NO_KEYWORDS)} END")},
  {fill(fv.SUMMARY_TONE, tone=tone, pos=one(pos), neg=one(neg), neu=one(neu))},
  CASE WHEN len(labels) > 0 THEN {fill(fv.SUMMARY_TOPICS, topics=topic_text)} END,
  CASE WHEN len(handles) > 0 THEN {fill(fv.SUMMARY_INFLUENCER, handle='handles[1]',
        influence="printf('%.2f', best_influence)")} END) END"""
    advice = f"""list_filter([
  CASE WHEN total_posts < 100 THEN {lit(fv.ADVICE_FEW_POSTS)} END,
  CASE WHEN {neg} > 35 THEN {fill(negative_text, neg=one(neg), topic=f"coalesce(all_labels[1], {lit(fv.ADVICE_MAIN_TOPIC)})")}
    WHEN {pos} > 60 THEN {fill(fv.ADVICE_POSITIVE, pos=one(pos))} END,
  CASE WHEN len(handles) > 0 THEN {fill(fv.ADVICE_INFLUENCERS, handles="array_to_string(handles[1:3], '، ')")} END,
  CASE WHEN len(all_labels) >= 3 THEN {fill(fv.ADVICE_FOCUS, topics="array_to_string(all_labels[1:3], ', ')")} END,
  CASE WHEN days >= 3 THEN {lit(fv.ADVICE_TREND)} END], lambda a: a IS NOT NULL)"""
    return with_(
        (
            *SCORED_BASE,
            *request_ctes("scored"),
            "enriched AS (SELECT * FROM matched)",
            *topic_ctes("enriched", "cleaned_text", keys),
            f"tot AS ({totals('enriched', keys)})",
            f"sh AS ({shares('enriched', keys)})",
            *network_ctes("enriched", keys),
            f"nrec AS ({node_records(keys)})",
            f"erec AS ({edge_records(keys)})",
            inner,
            *lists,
            f"q AS (SELECT * FROM (VALUES {values}) AS v(request_id, keywords))",
            facts,
        ),
        f"""SELECT request_id, CASE WHEN total_posts < 20 THEN 'failed' ELSE 'completed' END AS status,
  CASE WHEN total_posts < 20 THEN {few} END AS error_message,
  total_posts, total_users, total_reach, {pos}, {neu}, {neg},
  top_topics, top_influencers, sentiment_timeline, network_nodes, network_edges,
  {summary} AS summary,
  CASE WHEN len({advice}) = 0 THEN {lit(fv.ADVICE_DEFAULT)} ELSE array_to_string({advice}, ' // ') END AS recommendations
FROM (SELECT *, all_labels[1:5] AS labels FROM facts)""",
    )


def file_rows(dataset: str) -> str:
    return with_(
        (POSTS,),
        f"""SELECT {strip('text')} AS text, created_at, user_id, CAST(0 AS BIGINT) AS user_followers, likes,
  'ar' AS lang, label, {lit(dataset)} AS source_dataset FROM posts WHERE {strip('text')} <> ''""",
    )


SIMPLE_EDGES = (
    "edge AS (SELECT DISTINCT source_dataset, least(src, dst) AS a, greatest(src, dst) AS b "
    f"FROM ({author_edges('posts_m', ('source_dataset',))}))"
)


def graph_metrics() -> str:
    k = "source_dataset"
    return with_(
        (
            *BASE,
            f"node AS (SELECT {k}, handle AS id FROM ({activity('posts_m', (k,))}))",
            SIMPLE_EDGES,
            f"sym AS (SELECT {k}, a AS u, b AS v FROM edge UNION ALL SELECT {k}, b, a FROM edge)",
            f"deg AS (SELECT {k}, u AS id, count(*) AS d FROM sym GROUP BY {k}, u)",
            f"""tri AS (SELECT x.{k}, x.u AS id, count(*) AS t FROM sym x JOIN sym y
  ON x.{k} = y.{k} AND x.v = y.u JOIN sym z ON z.{k} = y.{k} AND z.u = y.v AND z.v = x.u GROUP BY x.{k}, x.u)""",
            f"""local AS (SELECT n.{k}, CASE WHEN coalesce(d, 0) < 2 THEN 0.0 ELSE coalesce(t, 0) / (d * (d - 1)) END AS c
  FROM node n LEFT JOIN deg g ON g.{k} = n.{k} AND g.id = n.id LEFT JOIN tri r ON r.{k} = n.{k} AND r.id = n.id)""",
            f"""reach AS (SELECT {k}, id, id AS r FROM node UNION
  SELECT s.{k}, s.v, reach.r FROM reach JOIN sym s ON s.{k} = reach.{k} AND s.u = reach.id)""",
            f"""part AS (SELECT {k}, count(DISTINCT lab) AS components FROM
  (SELECT {k}, id, min(r) AS lab FROM reach GROUP BY {k}, id) GROUP BY {k})""",
        ),
        f"""SELECT n.{k}, CASE WHEN m.m IS NULL THEN 0.0 ELSE {rounded('2.0 * m.m / (n.n * (n.n - 1))', 4)} END AS density,
  CASE WHEN m.m IS NULL THEN 0.0 ELSE {rounded('c.c', 4)} END AS avg_clustering,
  CASE WHEN m.m IS NULL THEN 0 ELSE p.components END AS components
FROM (SELECT {k}, count(*) AS n FROM node GROUP BY {k}) n
LEFT JOIN (SELECT {k}, count(*) AS m FROM edge GROUP BY {k}) m ON m.{k} = n.{k}
LEFT JOIN (SELECT {k}, avg(c) AS c FROM local GROUP BY {k}) c ON c.{k} = n.{k}
LEFT JOIN part p ON p.{k} = n.{k}""",
    ).replace("WITH ", "WITH RECURSIVE ", 1)


def all_queries() -> dict[str, str]:
    lang, source = ("lang",), ("source_dataset",)
    keywords = ["مكتبة", "أَحْمَد", "THE"]
    safe = "CASE WHEN post_id % 3 = 0 THEN created_at ELSE CAST(likes AS VARCHAR) END"
    label = (
        "CASE WHEN post_id % 5 = 0 THEN ' LABEL_' || label WHEN post_id % 5 = 1 THEN 'Pos' || lang "
        "WHEN post_id % 5 = 2 THEN 'Negative' ELSE label END"
    )
    strict = "CAST(try_strptime(left(created_at, 25), ['%Y-%m-%dT%H:%M:%S', '%Y-%m-%d %H:%M:%S', '%Y-%m-%d']) AS DATE)"
    in_class = f"""CASE WHEN coalesce(l, '') = '' THEN 'neutral'
  WHEN contains(lower(trim(l)), 'pos') OR lower(trim(l)) IN ('label_2', '2') THEN 'positive'
  WHEN contains(lower(trim(l)), 'neg') OR lower(trim(l)) IN ('label_0', '0') THEN 'negative' ELSE 'neutral' END"""
    apart = "text"
    for letter, plain, mark in (("é", "e", 769), ("è", "e", 768), ("ê", "e", 770), ("ü", "u", 776), ("ö", "o", 776)):
        apart = f"replace({apart}, '{letter}', '{plain}' || chr({mark}))"
    unfollowed = "unfollowed AS (SELECT * REPLACE (CAST(0 AS BIGINT) AS user_followers) FROM posts_m)"
    unknown = (
        "unknown AS (SELECT * REPLACE (CAST(0 AS BIGINT) AS user_followers) FROM nobody)"
    )
    return {
        "unescaped_pages": """SELECT page_id, sha256(regexp_replace(replace(replace(replace(html,
  '&copy;', '©'), '&middot;', '·'), '&quot;', '"'), '&amp;?', '&', 'g')) AS html_hash FROM pages""",
        "composed_documents": f"SELECT doc_id, sha256(nfc_normalize({apart})) AS text_hash FROM documents",
        "search_key": with_((POSTS,), f"SELECT post_id, {search_key('text')} AS search_key FROM posts"),
        "normalize_steps": with_(
            (POSTS,),
            f"""SELECT post_id, {no_marks('text')} AS no_marks, {table_map('text', fv.FULL_LETTERS)} AS letters,
  {digits('text')} AS digits, nfc_normalize(text) AS nfc FROM posts""",
        ),
        "normalize_for_search": with_(
            (POSTS,), f"SELECT post_id, {full_key('text')} AS normalized FROM posts"
        ),
        "normalize_for_display": with_(
            (POSTS,), f"SELECT post_id, {collapse('nfc_normalize(text)')} AS displayed FROM posts"
        ),
        "extract_names": with_(
            (POSTS,),
            f"""SELECT post_id, array_to_string({names('text', '@', 30)}, ' ') AS mentions,
  array_to_string({names('text', '#', 50)}, ' ') AS hashtags,
  regexp_matches(text, {lit(RETWEET)}) AS is_retweet FROM posts""",
        ),
        "clean_text": with_(CLEAN_BASE, "SELECT post_id, cleaned_text FROM cleaned"),
        "clean_text_keeping_names": with_(
            (POSTS,),
            f"SELECT post_id, {clean('text', True, False, False)} AS cleaned_text FROM posts",
        ),
        "valid_posts": with_((*CLEAN_BASE, VALID), "SELECT post_id FROM valid"),
        "topic_tokens": with_(
            (POSTS, *document_ctes("posts", "text")), "SELECT post_id, document FROM docs"
        ),
        "handle_forms": with_(
            (POSTS,),
            """SELECT post_id, lower(ltrim(user_handle, '@')) AS handle_key,
  '@' || lower(ltrim(user_handle, '@')) AS handle_display FROM posts WHERE user_handle IS NOT NULL""",
        ),
        "text_hash": with_((POSTS,), "SELECT post_id, sha256(text) AS text_hash FROM posts"),
        "safe_integers": with_(
            (POSTS,),
            f"""SELECT post_id, CASE WHEN regexp_matches({safe}, '^[+-]?[0-9]+$')
  THEN CAST({safe} AS BIGINT) ELSE 0 END AS likes FROM posts""",
        ),
        "post_days": with_(
            (POSTS,),
            f"""SELECT post_id, strftime({DAY}, '%Y-%m-%d') AS day,
  strftime({strict}, '%Y-%m-%d') AS strict_day FROM posts""",
        ),
        "keyword_filter": with_(
            (POSTS,), f"SELECT post_id FROM posts WHERE {keyword_test('text', keywords)}"
        ),
        "date_filter": with_(
            (POSTS,), f"SELECT post_id FROM posts WHERE {in_days('2024-01-03', '2024-01-10')}"
        ),
        "full_filter": with_(
            (POSTS, f"kept AS ({first_copies('posts', 'text')})"),
            f"""SELECT post_id, source_dataset FROM posts JOIN kept USING (post_id)
WHERE {keyword_test('text', keywords)} AND {in_days('2024-01-03', None)}""",
        ),
        "dedup_hash": with_((POSTS,), first_copies("posts", "sha256(text)")),
        "dedup_hash_normalized": with_((POSTS,), first_copies("posts", search_key("text"))),
        "dedup_exact": with_(
            (*CLEAN_BASE, f"k AS (SELECT post_id, {full_key(ANALYSIS_TEXT)} AS k FROM cleaned)"),
            first_copies("k", "k", "k <> ''"),
        ),
        "request_stats": with_((POSTS, *request_ctes("posts")), totals("matched", ("request_id",))),
        "nation_request_stats": with_(
            (
                POSTS,
                NATION_REQUESTS,
                NATION_PAIRS,
                f"""chosen AS (SELECT * FROM (SELECT * FROM npairs
  QUALIFY row_number() OVER (PARTITION BY request_id, text ORDER BY post_id) = 1)
  WHERE {DAY} IS NULL OR ((d1 IS NULL OR {DAY} >= d1) AND (d2 IS NULL OR {DAY} <= d2)))""",
            ),
            totals("chosen", ("request_id",)),
        ),
        "dedup_near": with_(
            (POSTS, *NEAR),
            """SELECT p.post_id, p.source_dataset FROM posts p JOIN docs USING (post_id)
ANTI JOIN removed USING (post_id)""",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "request_matches_by_join": with_(
            (POSTS, NATION_REQUESTS, NATION_PAIRS), "SELECT post_id, request_id FROM npairs"
        ),
        "density_clusters": with_(
            (
                "vectors AS (SELECT label, vec_id AS post_id, embedding AS e FROM embeddings)",
                *density_ctes("vectors", "label", 0.82, 5),
            ),
            "SELECT label, post_id, cluster FROM clustered",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "density_topics": with_(
            (
                *CLEAN_BASE,
                "vectors AS (SELECT c.lang, c.post_id, v.embedding AS e FROM cleaned c JOIN embeddings v ON v.vec_id = c.post_id)",
                *density_ctes("vectors", "lang", 0.82, 5),
                f"""words AS (SELECT k.lang, k.cluster, unnest(regexp_extract_all({document('c.cleaned_text')}, {lit(fv.WORD)})) AS term
  FROM clustered k JOIN cleaned c ON c.post_id = k.post_id)""",
                "tf AS (SELECT lang, cluster, term, count(*) AS tf FROM words GROUP BY lang, cluster, term)",
                """weighed AS (SELECT lang, cluster, term, round(tf / n * ln(1 + average / f), 9) AS w
  FROM tf JOIN (SELECT lang, term, sum(tf) AS f FROM tf GROUP BY lang, term) USING (lang, term)
  JOIN (SELECT lang, cluster, sum(tf) AS n FROM tf GROUP BY lang, cluster) USING (lang, cluster)
  JOIN (SELECT lang, avg(n) AS average FROM (SELECT lang, cluster, sum(tf) AS n FROM tf GROUP BY lang, cluster)
    GROUP BY lang) USING (lang))""",
                """typical AS (SELECT lang, cluster, string_agg(term, ' ' ORDER BY w DESC, term) AS label FROM (
  SELECT * FROM weighed QUALIFY row_number() OVER (PARTITION BY lang, cluster ORDER BY w DESC, term) <= 2)
  GROUP BY lang, cluster)""",
                """sized AS (SELECT lang, cluster, posts, coalesce(label, '') AS label FROM
  (SELECT lang, cluster, count(*) AS posts FROM clustered GROUP BY lang, cluster) LEFT JOIN typical USING (lang, cluster))""",
                """best AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang ORDER BY posts DESC, label, cluster) AS INT) AS rank
  FROM sized)""",
            ),
            f"""SELECT lang, rank, label, CAST({rounded("100.0 * posts / max(posts) OVER (PARTITION BY lang)", 0)} AS INT) AS weight
FROM best WHERE rank <= 3""",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "request_stream": """WITH sent AS (
  SELECT 'n' || n_nationkey AS request_id, n_nationkey AS k, 1 AS batch FROM nation
  UNION ALL SELECT 'n' || n_nationkey, n_nationkey, 2 FROM nation WHERE n_nationkey % 2 = 0
  UNION ALL SELECT 'm' || n_nationkey, n_nationkey, 2 FROM nation WHERE n_nationkey % 6 = 0),
answered AS (SELECT *, k % 6 = 0 AS bad, k % 6 <> 0 AND lag(batch) OVER (PARTITION BY request_id ORDER BY batch) IS NOT NULL
  AS done FROM sent)
SELECT request_id, count(*) FILTER (NOT done) AS queued, count(*) FILTER (done) AS already_completed,
  count(*) FILTER (NOT done) AS analysed, CASE WHEN any_value(bad) THEN 'failed' ELSE 'completed' END AS status,
  count(*) FILTER (NOT done AND NOT bad AND k % 5 > 0) AS notices
FROM answered GROUP BY request_id""",
        "daily_users": with_(
            (POSTS,),
            f"""SELECT lang, count(DISTINCT user_id) AS users, true AS as_whole, true AS near
FROM posts WHERE {DAY} IS NOT NULL GROUP BY lang""",
        ),
        "order_request_matches": with_(
            (POSTS, ORDER_KEYWORDS, ORDER_PAIRS),
            """SELECT request_id, count(*) AS posts, min(post_id) AS first_post FROM okw JOIN opairs USING (kw)
WHERE src IS NULL OR src = source_dataset GROUP BY request_id""",
        ),
        "event_stats": with_((EVENT_POSTS,), totals("event_posts", ("event_type",))),
        "overall_stats": with_((POSTS,), totals("posts")),
        "overall_stats_by_language": with_((POSTS,), totals("posts", lang)),
        "overall_stats_fallbacks": with_((*BASE, NOBODY, unknown), totals("unknown", source)),
        "dataset_breakdown": with_(
            (*CLEAN_BASE, VALID),
            """SELECT source_dataset, count(*) AS posts FROM valid WHERE source_dataset <> '' GROUP BY source_dataset""",
        ),
        "lexicon_sentiment": with_(
            SCORED_BASE, "SELECT post_id, left(body, 200) AS text, sentiment AS label, score FROM scored"
        ),
        "label_classes": with_(
            (POSTS, f"named AS (SELECT post_id, {label} AS l FROM posts)"),
            f"SELECT post_id, {in_class} AS sentiment FROM named",
        ),
        "model_sentiment": with_(
            (*CLEAN_BASE, VALID),
            """SELECT post_id, CASE length(body) % 3 WHEN 2 THEN 'positive' WHEN 0 THEN 'negative' ELSE 'neutral' END AS sentiment,
  CAST(0.5 AS DOUBLE) + length(body) % 4 / 8 AS score FROM valid""",
        ),
        "sentiment_shares": with_(SCORED_BASE, shares("scored")),
        "sentiment_shares_by_language": with_(SCORED_BASE, shares("scored", lang)),
        "dominant_sentiment": with_(
            (*SCORED_BASE, f"sh AS ({shares('scored', source)})"),
            """SELECT source_dataset, CASE WHEN sentiment_positive >= sentiment_neutral AND sentiment_positive >= sentiment_negative
  THEN 'positive' WHEN sentiment_neutral >= sentiment_negative THEN 'neutral' ELSE 'negative' END AS tone FROM sh""",
        ),
        "sentiment_timeline": with_(SCORED_BASE, timeline("scored")),
        "sentiment_timeline_strict": with_(SCORED_BASE, timeline("scored", lang, strict)),
        "mention_counts": with_(BASE, mention_counts("posts_m")),
        "user_stats": with_(BASE, user_stats("posts_m")),
        "influencers": influencers("posts_m", extra=BASE),
        "influencers_by_language": influencers("posts_m", lang, 5, BASE),
        "influencers_without_followers": influencers("unfollowed", extra=(*BASE, unfollowed)),
        "influencers_without_users": influencers("nobody", lang, 10, (*BASE, NOBODY)),
        "node_activity": with_(BASE, activity("posts_m")),
        "mention_edges": with_(BASE, author_edges("posts_m")),
        "network_edges_by_handle": with_(
            (*BASE, *network_ctes("posts_m", (), 20, 100000)), "SELECT src, dst, weight FROM tope"
        ),
        "weighted_degree": with_(
            (*BASE, f"e AS ({author_edges('posts_m')})"),
            """SELECT handle, CAST(sum(weight) AS BIGINT) AS degree FROM (SELECT src AS handle, weight FROM e
  UNION ALL SELECT dst, weight FROM e) GROUP BY handle""",
        ),
        "network_nodes": with_((*BASE, *network_ctes("posts_m", (), 30)), node_records()),
        "network_edges": with_((*BASE, *network_ctes("posts_m", (), 30)), edge_records()),
        "network_nodes_by_language": with_(
            (*BASE, *network_ctes("posts_m", lang, 10, 40)), node_records(lang)
        ),
        "network_edges_by_language": with_(
            (*BASE, *network_ctes("posts_m", lang, 10, 40)), edge_records(lang)
        ),
        "graph_metrics": graph_metrics(),
        "graph_triangles": with_(
            (
                *BASE,
                f"""sym AS (SELECT DISTINCT u, v FROM (SELECT src AS u, dst AS v FROM ({author_edges('posts_m')}) 
  UNION ALL SELECT dst, src FROM ({author_edges('posts_m')})))""",
            ),
            """SELECT x.u AS id, CAST(count(*) / 2 AS BIGINT) AS triangles FROM sym x JOIN sym y ON x.v = y.u
JOIN sym z ON z.u = y.v AND z.v = x.u GROUP BY x.u""",
        ),
        "component_sizes": """SELECT concat('c', o_custkey) AS component, 1 + count(*) AS size
FROM orders GROUP BY o_custkey""",
        "term_statistics": with_(
            (POSTS, *document_ctes("posts", "text")), "SELECT term, df, cf FROM stat"
        ),
        "phrase_scores": with_(
            (POSTS, *phrase_ctes("posts", "text")), "SELECT term, round(score, 5) AS score FROM phrase"
        ),
        "extract_topics": with_(
            (*CLEAN_BASE, *topic_ctes("cleaned", "cleaned_text")),
            "SELECT rank, label, weight FROM topic",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "extract_topics_by_language": with_(
            (*CLEAN_BASE, *topic_ctes("cleaned", "cleaned_text", lang, 5)),
            "SELECT lang, rank, label, weight FROM topic",
        ).replace("WITH ", "WITH RECURSIVE ", 1),
        "analysis_results": analysis().replace("WITH ", "WITH RECURSIVE ", 1),
        "read_csv": file_rows("corpus_csv"),
        "read_csv_gz": file_rows("corpus_csv.gz"),
        "read_jsonl": file_rows("corpus_jsonl"),
        "read_parquet": file_rows("corpus_parquet"),
        "union_datasets": with_(
            (POSTS,),
            f"""SELECT 'corpus_jsonl' AS source_dataset, count(*) AS posts, count(*) AS ids FROM conversations
  WHERE {strip('text')} <> '' UNION ALL SELECT 'corpus_parquet', count(*), count(*) FROM posts WHERE {strip('text')} <> ''""",
        ),
        "capped_datasets": with_(
            (
                POSTS,
                """placed AS (SELECT post_id, source_dataset, CAST(replace(source_dataset, 'src', '') AS INT) AS place,
  row_number() OVER (PARTITION BY source_dataset ORDER BY post_id) AS own FROM posts)""",
            ),
            """SELECT post_id, source_dataset FROM placed WHERE own <= 40
QUALIFY row_number() OVER (ORDER BY place, post_id) <= 150""",
        ),
        "dataset_catalog": with_(
            (
                POSTS,
                """known AS (SELECT source_dataset AS id, bool_or(created_at IS NOT NULL) AS has_timestamp,
  bool_or(user_id IS NOT NULL AND user_followers > 5000) AS has_user_metadata, count(*) AS n FROM posts GROUP BY source_dataset)""",
            ),
            """SELECT id, n AS size_estimate_rows, has_user_metadata AS supports_influencers,
  has_user_metadata AS supports_network, has_timestamp AS supports_timeline
FROM known WHERE has_timestamp AND has_user_metadata AND id IN ('src1', 'src2', 'src3', 'src4')""",
        ),
        "pending_requests": with_(
            (ORDER_REQUESTS,),
            """SELECT request_id, status FROM oreq WHERE status = 'pending' ORDER BY created_at, request_id LIMIT 20""",
        ),
        "request_status": with_(
            (ORDER_REQUESTS,),
            """SELECT request_id, coalesce(status, 'unknown') AS status, coalesce(progress, 0) AS progress,
  error_message FROM oreq""",
        ),
        "request_admission": with_(
            (ORDER_REQUESTS,),
            """SELECT request_id, CASE WHEN status = 'completed' THEN 'already_completed'
  WHEN status IN ('collecting', 'analyzing') THEN 'already_processing' ELSE 'queued' END AS admission FROM oreq""",
        ),
        "current_status": """SELECT CAST(l_orderkey AS VARCHAR) AS request_id,
  CAST(arg_max(l_linenumber, (l_shipdate, l_linenumber)) AS INT) AS progress,
  arg_max(l_returnflag, (l_shipdate, l_linenumber)) FILTER (l_linenumber % 3 = 1) AS error_message
FROM lineitem GROUP BY l_orderkey""",
        "fetch_results": with_(
            (
                ORDER_REQUESTS,
                """res AS (SELECT CAST(l_orderkey AS VARCHAR) AS request_id, count(*) AS total_posts
  FROM lineitem WHERE l_linenumber > 3 GROUP BY l_orderkey)""",
            ),
            """SELECT o.request_id, o.status, r.request_id IS NOT NULL AS ready, r.total_posts
FROM oreq o LEFT JOIN res r ON r.request_id = o.request_id""",
        ),
        "replace_results": with_(
            (
                POSTS,
                f"new AS ({totals('(SELECT * FROM posts WHERE lang <> ' + lit('en') + ' AND likes > 0)', lang)})",
                f"old AS ({totals('posts', lang)})",
            ),
            """SELECT lang AS request_id, total_posts, total_users, total_reach FROM new
UNION ALL SELECT lang, total_posts, total_users, total_reach FROM old WHERE lang NOT IN (SELECT lang FROM new)""",
        ),
        "notifications": with_(
            (ORDER_REQUESTS,),
            f"""SELECT user_id, 'analysis_complete' AS type, {lit(fv.NOTICE_TITLE)} AS title,
  replace({lit(fv.NOTICE_BODY)}, '{{title}}', title) AS body, '#analysis-' || request_id AS link, false AS is_read
FROM oreq WHERE user_id IS NOT NULL AND status = 'completed'""",
        ),
        "audit_rows": with_(
            (ORDER_REQUESTS,),
            """SELECT CASE WHEN status = 'completed' THEN 'ANALYSIS_COMPLETED' ELSE 'ANALYSIS_FAILED' END AS action,
  'analysis_request' AS entity_type, request_id AS entity_id,
  CASE WHEN status = 'completed'
    THEN '{"total_posts":' || coalesce(progress, 0) || ',"duration_seconds":1.5,"datasets_used":{"src":1}}'
    WHEN error_message IS NULL THEN '{}' ELSE '{"error":"' || error_message || '"}' END AS metadata FROM oreq""",
        ),
        "timeline_stream": with_(SCORED_BASE, timeline("scored")),
        "dedup_stream": with_((POSTS,), "SELECT DISTINCT sha256(text) AS text_hash FROM posts"),
    }

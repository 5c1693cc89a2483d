"""The queries' equivalents in ANSI-style SQL, assembled from shared common table expressions."""

from __future__ import annotations

from linkforge.functions import dictionaries as D
from linkforge.operators.decide import WEIGHTS_B, WEIGHTS_V1, WEIGHTS_V2
from linkforge.plans.adapters import RECORD

CAPS, GRID = [5, 10, 20, 50], [i / 20 for i in range(2, 20)]
POOL_CAPS, GATES, RELS = [120, 300, 500, 1000, 1 << 30], [0.0, 0.5, 0.7], [0.0, 0.8, 0.95]


def _in(values) -> str:
    return "(" + ", ".join(f"'{v}'" for v in values) + ")"


def _rewrite(x: str, table: dict[str, str]) -> str:
    cases = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in table.items())
    return f"array_to_string(list_transform(list_filter(str_split({x}, ' '), lambda t: t <> ''), lambda t: CASE t {cases} ELSE t END), ' ')"


def _squash(x: str) -> str:
    return f"trim(regexp_replace(replace({x}, '&', ' and '), '[^\\p{{L}}\\p{{N}}_]+', ' ', 'g'))"


def _bare(x: str) -> str:
    return f"regexp_replace({x}, '\\.({'|'.join(D.DOMAINS)})\\b', '', 'g')"


def _words(x: str) -> str:
    return f"list_filter(str_split({x}, ' '), lambda t: t <> '')"


def _sig(x: str, stop=D.STOP + D.LEGAL_STOP, least: int = 3) -> str:
    return f"list_filter({_words(x)}, lambda t: length(t) >= {least} AND t NOT IN {_in(stop)})"


def _nums(x: str, least: int = 3) -> str:
    return f"list_filter(regexp_extract_all({x}, '\\p{{Nd}}+'), lambda t: length(t) >= {least})"


def _distinct(x: str) -> str:
    """First occurrences in order."""
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def _join(x: str) -> str:
    return f"coalesce(array_to_string({x}, '~'), '')"


LN, LA = "lower(business_name)", "lower(business_address)"
COMPACT = "replace(name_norm, ' ', '')"
ADDR_TOKENS = f"list_slice({_distinct(f'list_filter({_words("addr_norm")}, lambda t: length(t) >= 4 AND regexp_full_match(t, {chr(39)}\\p{{L}}+{chr(39)}) AND t NOT IN {_in(D.ADDR_STOP)})')}, 1, 6)"
NAME = _rewrite(_squash(_bare(LN)), D.LEGAL)
ADDR = _rewrite(_squash(LA), D.LEGAL | D.STREET)

def _base(name: str, addr: str) -> str:
    """Records, keys and sides by the expressions of a generation's normal forms."""
    return f"""r0 AS (SELECT {", ".join(f"{e} AS {k}" for k, e in RECORD.items())} FROM part),
r AS (SELECT *, {name} AS name_norm, {addr} AS addr_norm, trim(lower(country)) AS country_key, {_squash(LN)} AS name_key FROM r0),
k AS (SELECT *, {_sig("name_norm")} AS toks, {_distinct(_sig("name_norm"))} AS dtoks, {_nums("addr_norm")} AS ns, {_distinct(_nums("addr_norm"))} AS dns, {ADDR_TOKENS} AS atoks FROM r),
s AS (SELECT entity_id AS s1, * FROM k WHERE source = 'S1'),
t AS (SELECT entity_id AS id, * FROM k WHERE source <> 'S1'),
truth AS (SELECT s.s1, t.id FROM s JOIN t USING (truth_key))"""


BASE = _base(NAME, ADDR)


def _pairs_of(x: str, glue: str) -> str:
    return f"flatten(list_transform({x}, lambda a, i: list_transform(list_slice({x}, i + 1, len({x})), lambda b: least(a, b) || '{glue}' || greatest(a, b))))"


def _products(a: str, b: str) -> str:
    return f"flatten(list_transform({a}, lambda a: list_transform({b}, lambda b: a || '#' || b)))"


def _route(route: str, keys: str, of: str = "t") -> str:
    return f"SELECT '{route}' AS route, unnest({keys}) AS key, id, source, ord FROM {of}"


def _single(route: str, key: str, where: str) -> str:
    return f"SELECT '{route}' AS route, {key} AS key, id, source, ord FROM t WHERE {where}"


SORTED_SIG = "array_to_string(list_sort(dtoks), ' ')"
POST_V1 = " UNION ALL ".join([_single("name", "name_norm", "name_norm <> ''"), _single("prefix", f"{COMPACT}[:3]", "name_norm <> ''"), _route("token", _sig("name_norm", D.STOP)), _route("num", "ns")])
POST_V2 = " UNION ALL ".join([_single("name", "name_norm", "name_norm <> ''"), _single("prefix", f"{COMPACT}[:4]", f"length({COMPACT}) >= 3"), _route("token", "dtoks"), _single("sig", SORTED_SIG, f"{SORTED_SIG} <> ''"), _route("num", "ns")])
POST_PAIR = " UNION ALL ".join([_route("pair", _pairs_of("list_slice(dtoks, 1, 8)", "|")), _route("toknum", _products("list_slice(dtoks, 1, 8)", "list_slice(dns, 1, 6)"))])
_AUX = {"numtok": _route("numtok", _products("list_slice(dns, 1, 3)", "atoks")), "numnum": _route("numnum", _pairs_of("list_slice(dns, 1, 3)", "#")), "cpre8": _single("cpre8", f"{COMPACT}[:8]", f"length({COMPACT}) >= 8")}

_PLAIN = "kept AS (SELECT route, key, id, source FROM (SELECT *, row_number() OVER (PARTITION BY route, key ORDER BY source, ord, id) AS rn FROM p) x JOIN lim USING (route, key) WHERE rn <= most)"
_BALANCED = """share AS (SELECT *, CASE WHEN s2 + s3 <= most THEN s3 ELSE least(s3, greatest(most // 2, most - s2)) END AS n3 FROM (SELECT *, least(c2, most) AS s2, least(c3, most) AS s3 FROM lim)),
kept AS (SELECT route, key, id, source FROM (SELECT *, row_number() OVER (PARTITION BY route, key, source ORDER BY ord, id) AS rn FROM p) x JOIN share USING (route, key)
  WHERE rn <= CASE WHEN source = 'S3' THEN n3 WHEN s2 + s3 <= most THEN s2 ELSE most - n3 END)"""


def _limits(limits: dict[str, int]) -> str:
    cases = " ".join(f"WHEN '{r}' THEN {n}" for r, n in limits.items())
    return f"""lim AS (SELECT route, key, count(DISTINCT id) AS df, count(*) FILTER (WHERE source = 'S2') AS c2, count(*) FILTER (WHERE source = 'S3') AS c3,
  CASE route {cases} ELSE CASE WHEN count(DISTINCT id) <= 800 THEN least(2000, greatest(80, count(DISTINCT id))) ELSE 40 END END AS most FROM p GROUP BY route, key)"""


def _ask(route: str, keys: str, w: float) -> str:
    return f"SELECT s1, '{route}' AS route, unnest({keys}) AS key, {w}::double AS w FROM s"


def _ask1(route: str, key: str, where: str, w: float) -> str:
    return f"SELECT s1, '{route}' AS route, {key} AS key, {w}::double AS w FROM s WHERE {where}"


def _old(base: str, posts: str, asks: list[str], rare: float, most: int, country: float, cap: int, more: str = "") -> str:
    """The first two generations: plain limits, a token's weight by its bucket."""
    asks = [*asks, f"SELECT s1, 'token' AS route, key, 2.0::double / (1 + n / {rare}::double) AS w FROM (SELECT s1, unnest({_sig('name_norm', D.STOP)}) AS key FROM s) JOIN (SELECT key, count(*) AS n FROM p WHERE route = 'token' GROUP BY key) USING (key)"]
    return f"""{base}, p AS ({posts}), {_limits({"name": most, "prefix": most, "token": most, "num": most, "country": 40})}, {_PLAIN}, q AS ({" UNION ALL ".join(asks)}){_TFIDF if more else ""}, {_final(_HITS + more, country, cap)}"""


def _final(hits: str, country: float, cap: int) -> str:
    return f"""w AS (SELECT s1, id, sum(w) AS w, list_sort(list_distinct(flatten(list(routes)))) AS routes FROM ({hits}) GROUP BY s1, id),
scored AS (SELECT w.s1, w.id, w.routes, round(CASE WHEN s.country_key <> '' AND t.country_key <> '' AND s.country_key <> t.country_key THEN w.w * {country}::double ELSE w.w END, 9) AS score
  FROM w JOIN s USING (s1) JOIN t USING (id)),
pool AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY score DESC, id) AS rank FROM scored),
c AS (SELECT * FROM pool WHERE rank <= {cap})"""


_HITS = "SELECT s1, id, w, [route] AS routes FROM q JOIN kept USING (route, key)"
_WORDS = _words("name_norm || ' ' || addr_norm")
_GRAMS = f"flatten(list_transform({_WORDS}, lambda w: flatten(list_transform([3, 4, 5], lambda n: list_transform(range(1, (length(w) + 4 - n)::bigint), lambda i: (' ' || w || ' ')[i:i + n - 1])))))"
_TFIDF = f""", gt AS (SELECT id, g, count(*) AS tf FROM (SELECT id, unnest({_GRAMS}) AS g FROM t) GROUP BY id, g), gs AS (SELECT s1, g, count(*) AS tf FROM (SELECT s1, unnest({_GRAMS}) AS g FROM s) GROUP BY s1, g),
idf AS (SELECT g, ln((1 + (SELECT count(*) FROM t))::double / (1 + count(*))) + 1 AS idf FROM gt GROUP BY g),
wt AS (SELECT id, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY id)) AS w FROM gt JOIN idf USING (g)), ws AS (SELECT s1, g, tf * idf / sqrt(sum(tf * idf * tf * idf) OVER (PARTITION BY s1)) AS w FROM gs JOIN idf USING (g)),
near AS (SELECT s1, id, round(sum(ws.w * wt.w), 9) AS similarity FROM ws JOIN wt USING (g) GROUP BY s1, id),
knn AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY similarity DESC, id) AS rank FROM near QUALIFY rank <= 20)"""
_V1_LIMITS = {"name": 40, "prefix": 40, "token": 40, "num": 40}
_V1_KEYS = " UNION ALL ".join([_ask1("name", "name_norm", "name_norm <> ''", 5.0), _ask1("prefix", f"{COMPACT}[:3]", "name_norm <> ''", 1.0), _ask("token", _sig("name_norm", D.STOP), 1.5), _ask("num", "ns", 2.0)])
V1 = f"{BASE}, p AS ({POST_V1}), {_limits(_V1_LIMITS)}, {_PLAIN}, q AS ({_V1_KEYS}), {_final(_HITS, 0.5, 50)}"


_A_BASE = _base(_rewrite(_squash(LN), D.SUFFIX_A), _rewrite(_squash(LA), D.SUFFIX_A | D.ADDRESS_A))
_B_BASE = _base(_rewrite(_squash(LN), D.LEGAL_B), _rewrite(_squash(LA), D.LEGAL_B | D.STREET_B))
_POST_A = " UNION ALL ".join([_single("prefix", f"{COMPACT}[:3]", "name_norm <> ''"), _route("token", _distinct(_sig("name_norm", D.STOP))), _route("num", "dns")])
_POST_B = " UNION ALL ".join([_single("name", "name_norm", "name_norm <> ''"), _single("prefix", "replace(name_key, ' ', '')[:3]", "name_norm <> ''"), _route("token", _sig("name_norm", D.STOP)), _route("num", "ns")])
A = _old(_A_BASE, _POST_A, [_ask1("prefix", f"{COMPACT}[:3]", "name_norm <> ''", 1.0), _ask("num", "ns", 1.5)], 50.0, 200, 0.15, 80)
B = _old(_B_BASE, _POST_B, [_ask1("name", "name_norm", "name_norm <> ''", 5.0), _ask1("prefix", "replace(name_key, ' ', '')[:3]", "name_norm <> ''", 1.0), _ask("num", "ns", 1.8)], 40.0, 40, 0.5, 60, " UNION ALL SELECT s1, id, 2 * similarity, ['tfidf'] FROM knn")


def _d(cap: int, balanced: bool, pair: bool, aux: tuple[str, ...]) -> str:
    posts = " UNION ALL ".join([POST_V2, *([POST_PAIR] if pair else []), *(_AUX[a] for a in aux)])
    limits = {"name": 200, "sig": 200, "prefix": 60, "num": 80} | ({"pair": 200, "toknum": 100} if pair else {}) | {a: {"numtok": 50, "numnum": 50, "cpre8": 100}[a] for a in aux}
    asks = [_ask1("name", "name_norm", "name_norm <> ''", 8.0), _ask1("sig", SORTED_SIG, f"{SORTED_SIG} <> ''", 6.0), _ask1("prefix", f"{COMPACT}[:4]", f"length({COMPACT}) >= 4", 0.8), _ask("num", "ns", 2.2)]
    asks.append("SELECT s1, 'token' AS route, tok AS key, 1.2::double * greatest(ln(greatest(n, 2)::double) - ln(greatest(df, 1)::double), 0.5::double) AS w FROM ranked WHERE rk <= 8")
    if pair:
        asks += ["SELECT s1, 'pair' AS route, unnest(" + _pairs_of("top", "|") + ") AS key, 6.0::double AS w FROM tops", "SELECT s1, 'toknum' AS route, unnest(" + _products("list_slice(top, 1, 4)", "list_slice(dns, 1, 4)") + ") AS key, 5.0::double AS w FROM tops"]
    asks += [{"numtok": _ask("numtok", _products("list_slice(dns, 1, 3)", "atoks"), 4.0), "numnum": _ask("numnum", _pairs_of("list_slice(dns, 1, 3)", "#"), 4.0), "cpre8": _ask1("cpre8", f"{COMPACT}[:8]", f"length({COMPACT}) >= 8", 3.0)}[a] for a in aux]
    return f"""{BASE}, p AS ({posts}), {_limits(limits)}, {_BALANCED if balanced else _PLAIN},
tdf AS (SELECT key AS tok, count(DISTINCT id) AS df FROM p WHERE route = 'token' GROUP BY key),
each AS (SELECT s1, dns, unnest(toks) AS tok, generate_subscripts(toks, 1) AS pos FROM s),
known AS (SELECT s1, dns, each.tok, pos, coalesce(df, 0) AS df, n, CASE WHEN coalesce(df, 0) = 0 THEN n ELSE df END AS o FROM each LEFT JOIN tdf USING (tok) CROSS JOIN (SELECT count(*) AS n FROM t)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY o, pos) AS rk, count(*) OVER (PARTITION BY s1) AS m FROM known),
tops AS (SELECT s1, any_value(dns) AS dns, list_slice(list(tok ORDER BY o, tok), 1, 6) AS top FROM (SELECT DISTINCT s1, dns, tok, o FROM known) GROUP BY s1),
q AS ({" UNION ALL ".join(asks)}),
sets AS (SELECT s1, tok AS key, rk, count(*) OVER (PARTITION BY s1) AS n_sets FROM ranked WHERE m >= 2 AND rk <= 4 AND greatest(df, 1) <= 5000),
inter AS (SELECT s1, id FROM sets JOIN kept ON kept.route = 'token' AND kept.key = sets.key WHERE n_sets >= 2 GROUP BY s1, id HAVING count(DISTINCT rk) = max(n_sets)),
{_final(_HITS + " UNION ALL SELECT s1, id, 4.0::double, ['tok_intersect'] FROM inter", 0.55, cap)}"""


_RANKED = "SELECT s1, id, score, rank FROM c"
_ALL = ("numtok", "numnum", "cpre8")
_JAC = lambda a, b: f"CASE WHEN len(list_distinct(list_concat({a}, {b}))) = 0 THEN 0.0::double ELSE len(list_intersect(list_distinct({a}), list_distinct({b})))::double / len(list_distinct(list_concat({a}, {b}))) END"
_OVERLAP = f"CASE WHEN len(a.ns) > 0 AND len(b.ns) > 0 THEN {_JAC('a.ns', 'b.ns')} ELSE 0.0::double END"
_LONG = lambda x: f"list_filter({x}, lambda n: length(n) >= 5)"
_CONFLICT = "CASE WHEN len(a.ns) > 0 AND len(b.ns) > 0 AND NOT list_has_any(a.ns, b.ns) THEN 1.0::double ELSE 0.0::double END"
_AT = _sig("addr_norm")
PAIRS = f"""{V1}, sa AS (SELECT *, {_AT} AS asig FROM s), ta AS (SELECT *, {_AT} AS asig FROM t),
pr AS (SELECT c.s1, c.id, c.rank, c.score, b.source, a.name_norm AS na, b.name_norm AS nb, {_JAC("a.toks", "b.toks")} AS nj, {_JAC("a.asig", "b.asig")} AS aj, {_OVERLAP} AS num, {_CONFLICT} AS nc,
  CASE WHEN a.country_key <> '' AND a.country_key = b.country_key THEN 1.0::double ELSE 0.0::double END AS ce, CASE WHEN a.name_norm <> '' AND a.name_norm = b.name_norm THEN 1.0::double ELSE 0.0::double END AS ex,
  CASE WHEN len(a.dtoks) = 0 THEN 0.0::double ELSE len(list_intersect(a.dtoks, b.dtoks))::double / len(a.dtoks) END AS cont
  FROM c JOIN sa a ON a.s1 = c.s1 JOIN ta b ON b.id = c.id),
sc AS (SELECT *, round(0.4::double * nj + 0.2::double * aj + 0.2::double * num + 0.1::double * ce + 0.1::double * ex, 6) AS prob FROM pr)"""

PAIRS_LISTS = f"""{PAIRS}, pr2 AS (SELECT c.s1, c.id, c.rank, c.score, b.source, a.addr_norm AS aa, b.addr_norm AS ab, a.ns AS nsa, b.ns AS nsb, pr.nj, pr.aj FROM c JOIN pr ON pr.s1 = c.s1 AND pr.id = c.id JOIN s a ON a.s1 = c.s1 JOIN t b ON b.id = c.id)"""

LINKS = f"""{BASE}, links AS (SELECT s.s1, t.id FROM s JOIN t ON s.name_norm = t.name_norm WHERE s.name_norm <> '' AND CASE WHEN s.addr_norm <> '' AND t.addr_norm <> '' THEN s.addr_norm = t.addr_norm
  ELSE s.country_key <> '' AND s.country_key = t.country_key END)"""
_F = "CASE WHEN {tp} + {fp} + {fn} = 0 THEN 1.0::double ELSE 5.0::double * {tp} / (5 * {tp} + 4 * {fp} + {fn}) END"


def _entity(truth: str, links: str) -> str:
    return f"""e AS (SELECT s.s1, s.country, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp, coalesce(n_true, 0) - coalesce(tp, 0) AS fn FROM s
  LEFT JOIN (SELECT s1, count(*) AS n_true FROM {truth} GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS np FROM {links} GROUP BY s1) USING (s1)
  LEFT JOIN (SELECT s1, count(*) AS tp FROM {truth} JOIN {links} USING (s1, id) GROUP BY s1) USING (s1)),
f AS (SELECT *, {_F.format(tp="tp", fp="fp", fn="fn")} AS f05 FROM e)"""


_LINKS_CTE = LINKS[len(BASE) + 2 :]
ENTITY = f"{LINKS}, {_entity('truth', 'links')}"
ENTITY_V1 = f"{V1}, {_LINKS_CTE}, {_entity('truth', 'links')}"

# -- edit measures ----------------------------------------------------------------------------------

_CHARS = "string_split({0}, '')"
_MASK = f"map_from_entries(list_transform(list_distinct({_CHARS.format('a')}), lambda c: {{'k': c, 'v': list_reduce(list_prepend(0::hugeint, list_transform({_CHARS.format('a')}, lambda d, p: CASE WHEN d = c THEN 1::hugeint << (p - 1)::int ELSE 0::hugeint END)), lambda x, y: x + y)}}))"
_LCS = "n - bit_count(list_reduce(list_prepend(ones, list_transform(string_split({0}, ''), lambda c: coalesce(m[c], 0::hugeint))), lambda s, u: ((s + (s & u)) | (s - (s & u))) & ones))"
_SORTED = "array_to_string(list_sort(string_split({0}, ' ')), ' ')"
_SET = lambda x, y, how: f"array_to_string(list_sort(list_filter(list_distinct(string_split({x}, ' ')), lambda w: {how} list_contains(string_split({y}, ' '), w))), ' ')"


def edits(pairs: str) -> str:
    """CTE ed(x, y, ratio, tsort, tset, part, jw), 0 to 1, of all pairs (na, nb) and (aa, ab) of a CTE; strings of 1 to 120 characters or none."""
    return f"""ed0 AS (SELECT na AS x, nb AS y FROM {pairs} UNION SELECT aa, ab FROM {pairs}),
ed1 AS (SELECT *, {_SORTED.format("x")} AS sx, {_SORTED.format("y")} AS sy, {_SET("x", "y", "")} AS shared, {_SET("x", "y", "NOT")} AS lx, {_SET("y", "x", "NOT")} AS ly FROM ed0),
ed2 AS (SELECT *, trim(shared || ' ' || lx) AS ox, trim(shared || ' ' || ly) AS oy FROM ed1),
wanted AS (SELECT x AS a, y AS b FROM ed2 UNION SELECT sx, sy FROM ed2 UNION SELECT ox, oy FROM ed2),
masks AS MATERIALIZED (SELECT a, length(a) AS n, (1::hugeint << length(a)) - 1 AS ones, {_MASK} AS m FROM (SELECT a FROM wanted UNION SELECT b FROM wanted) u(a) WHERE a <> ''),
lk AS (SELECT a, b, 2.0::double * ({_LCS.format("b")}) / (n + length(b)) AS r FROM wanted JOIN masks USING (a) WHERE b <> '' UNION ALL SELECT a, b, CASE WHEN a = b THEN 1.0::double ELSE 0.0::double END FROM wanted WHERE a = '' OR b = ''),
ways AS (SELECT x AS a, y AS b FROM ed0 WHERE length(x) <= length(y) AND x <> '' UNION SELECT y, x FROM ed0 WHERE length(y) <= length(x) AND y <> ''),
wins AS (SELECT DISTINCT a, b, unnest(list_transform(range((1 - length(a))::bigint, length(b)::bigint), lambda i: b[greatest(i, 0) + 1:i + length(a)])) AS w FROM ways),
pk AS (SELECT a, b, max(2.0::double * ({_LCS.format("w")}) / (n + length(w))) AS r FROM wins JOIN masks USING (a) GROUP BY a, b),
ed AS (SELECT ed2.x, ed2.y, k1.r AS ratio, k2.r AS tsort,
  CASE WHEN ed2.x = '' OR ed2.y = '' THEN 0.0::double WHEN shared <> '' AND (lx = '' OR ly = '') THEN 1.0::double WHEN shared <> '' THEN greatest(k3.r, 2.0::double * length(shared) / (length(shared) + least(length(ox), length(oy)))) ELSE k3.r END AS tset,
  CASE WHEN ed2.x = '' AND ed2.y = '' THEN 1.0::double ELSE greatest(coalesce(p1.r, 0.0::double), coalesce(p2.r, 0.0::double)) END AS part,
  CASE WHEN ed2.x = ed2.y THEN 1.0::double WHEN ed2.x = '' OR ed2.y = '' THEN 0.0::double ELSE jaro_winkler_similarity(ed2.x, ed2.y) END AS jw
  FROM ed2 JOIN lk k1 ON k1.a = ed2.x AND k1.b = ed2.y JOIN lk k2 ON k2.a = sx AND k2.b = sy JOIN lk k3 ON k3.a = ox AND k3.b = oy
  LEFT JOIN pk p1 ON p1.a = ed2.x AND p1.b = ed2.y LEFT JOIN pk p2 ON p2.a = ed2.y AND p2.b = ed2.x)"""


def _pairs_with(candidates: str) -> str:
    """pr: candidates with both sides' forms and lists, and their edit measures; two empty strings measure 0 unless a feature says else."""
    return f"""{candidates}, pr AS MATERIALIZED (SELECT c.s1, c.id, c.rank, c.score, c.routes, b.source, a.name_norm AS na, b.name_norm AS nb, a.addr_norm AS aa, b.addr_norm AS ab, a.country_key AS ca, b.country_key AS cb,
  a.toks AS ta, b.toks AS tb, a.ns AS nsa, b.ns AS nsb, {_sig("a.addr_norm")} AS ra, {_sig("b.addr_norm")} AS rb FROM c JOIN s a ON a.s1 = c.s1 JOIN t b ON b.id = c.id), {edits("pr")},
pe AS (SELECT pr.*, en.ratio AS n_ratio, en.tsort AS n_sort, en.tset AS n_set, en.part AS n_part, en.jw AS n_jw, ea.ratio AS a_ratio, ea.tsort AS a_sort, ea.tset AS a_set, ea.part AS a_part, ea.jw AS a_jw,
  na = '' AND nb = '' AS no_name, aa = '' AND ab = '' AS no_addr FROM pr JOIN ed en ON en.x = na AND en.y = nb JOIN ed ea ON ea.x = aa AND ea.y = ab)"""


_OVER = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 THEN {_JAC(a, b)} ELSE 0.0::double END"
_CLASH = lambda a, b: f"CASE WHEN len({a}) > 0 AND len({b}) > 0 AND NOT list_has_any({a}, {b}) THEN 1.0::double ELSE 0.0::double END"
_BOOL = lambda x: f"CASE WHEN {x} THEN 1.0::double ELSE 0.0::double END"
_LEN = lambda a, b, empty: f"CASE WHEN greatest(length({a}), length({b})) = 0 THEN {empty}::double ELSE least(length({a}), length({b}))::double / greatest(length({a}), length({b})) END"
_CONT = lambda a, b: f"CASE WHEN len({a}) = 0 THEN 0.0::double ELSE len(list_intersect(list_distinct({a}), {b}))::double / len(list_distinct({a})) END"
_GUARD = lambda x, side: f"CASE WHEN {side} THEN 0.0::double ELSE {x} END"
_CORE = {
    "name_token_sort": _GUARD("n_sort", "no_name"), "name_jaccard": _JAC("ta", "tb"), "name_exact": _BOOL("na <> '' AND na = nb"), "addr_token_sort": _GUARD("a_sort", "no_addr"),
    "num_overlap": _OVER("nsa", "nsb"), "country_equal": _BOOL("ca <> '' AND ca = cb"), "name_addr_conflict": _BOOL("n_sort >= 0.85::double AND NOT no_name AND NOT no_addr AND a_sort > 0 AND a_sort < 0.45::double"),
    "name_partial": _GUARD("n_part", "no_name"), "addr_jaccard": _JAC("ra", "rb"),
}
_FLOATS = lambda cols: ", ".join(f"({e})::float AS {k}" for k, e in cols.items())


def _competition(name_s: str, addr_s: str) -> dict[str, str]:
    """The list-wise features over a CTE of pairs; both similarities as they are compared there."""
    strong = f"({name_s} >= 0.9::float)::int"
    best = f"max({name_s}) OVER w"
    second = f"nth_value({name_s}, 2) OVER (PARTITION BY s1 ORDER BY {name_s} DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)"
    place = lambda x: f"(row_number() OVER (PARTITION BY s1 ORDER BY {x} DESC, rank) - 1) / 300.0::double"
    return {
        "rank_frac": "(rank - 1) / 300.0::double", "log_score": "ln(1 + score::float::double)", "score_ratio_to_top": "score::float::double / greatest(max(score::float) OVER w, 1e-6::float)::double",
        "n_cands": "count(*) OVER w / 300.0::double", "name_s_rank": place(name_s),
        "name_s_gap_to_best_other": f"{name_s}::double - CASE WHEN {name_s} >= {best} THEN CASE WHEN count(*) OVER w > 1 THEN {second}::double ELSE 0.0::double END ELSE ({best})::double END",
        "n_cands_name_ge_09": f"sum({strong}) OVER w", "addr_s_rank": place(addr_s), "s1_addr_missing": "(trim(aa) = '')::int", "t_addr_missing": "(trim(ab) = '')::int", "num_conflict": _CLASH("nsa", "nsb"),
        "same_source_count_name_ge_09": f"sum({strong}) OVER (PARTITION BY s1, source = 'S2')",
    }


_EXTRA = {
    "name_jw": _GUARD("n_jw", "no_name"), "name_token_set": "n_set", "addr_token_set": "a_set", "addr_partial": _GUARD("a_part", "no_addr"),
    "first_num_equal": _BOOL("coalesce(nsa[1] = nsb[1], false)"), "long_num_shared": _BOOL(f"list_has_any({_LONG('nsa')}, {_LONG('nsb')})"), "long_num_conflict": _CLASH(_LONG("nsa"), _LONG("nsb")),
    "name_len_ratio": _LEN("na", "nb", 0.0), "addr_len_ratio": _LEN("aa", "ab", 0.0), "name_tok_contain_s1": _CONT("ta", "tb"), "name_tok_contain_t": _CONT("tb", "ta"),
}
_ROUTES = ("name", "sig", "prefix", "token", "tok_intersect", "pair", "toknum", "num", "numtok", "numnum", "cpre8")
_DIGITS = lambda x: f"regexp_extract_all({x}, '\\p{{Nd}}+')"
_FEATURES_A = {
    "name_jaccard": f"CASE WHEN no_name THEN 1.0::double ELSE {_JAC(_words('na'), _words('nb'))} END", "name_jaro": "n_jw", "name_token_sort": "n_sort", "name_partial": "n_part",
    "addr_jaccard": f"CASE WHEN no_addr THEN 1.0::double ELSE {_JAC(_words('aa'), _words('ab'))} END", "addr_jaro": "a_jw", "addr_token_sort": "a_sort",
    "num_overlap": _JAC(_DIGITS("aa"), _DIGITS("ab")), "country_equal": _CORE["country_equal"], "name_len_ratio": _LEN("na", "nb", 1.0), "addr_len_ratio": _LEN("aa", "ab", 1.0),
}
_SIG2 = lambda x: _sig(x, D.STOP, 2)
_NS, _AS = _GUARD("n_sort", "no_name"), _GUARD("a_sort", "no_addr")
_FEATURES_B = {
    "name_exact": _CORE["name_exact"], "addr_exact": _BOOL("aa <> '' AND aa = ab"), "name_jaro": _GUARD("n_jw", "no_name"), "name_ratio": "n_ratio", "name_token_sort": _NS, "name_token_set": "n_set", "name_partial": "n_part",
    "name_jaccard": _JAC(_SIG2("na"), _SIG2("nb")), "name_contain_ab": _CONT(_SIG2("na"), _SIG2("nb")), "name_contain_ba": _CONT(_SIG2("nb"), _SIG2("na")), "addr_jaro": _GUARD("a_jw", "no_addr"), "addr_ratio": "a_ratio",
    "addr_token_sort": _AS, "addr_jaccard": _JAC(_SIG2("aa"), _SIG2("ab")), "num_overlap": _OVER(_DIGITS("aa"), _DIGITS("ab")), "num_conflict": _CLASH(_DIGITS("aa"), _DIGITS("ab")), "country_equal": _CORE["country_equal"],
    "country_missing": _BOOL("ca = '' OR cb = ''"), "name_missing": _BOOL("na = '' OR nb = ''"), "addr_missing": _BOOL("aa = '' OR ab = ''"),
    "name_len_diff": "abs(length(na) - length(nb))::double / greatest(length(na), length(nb), 1)", "addr_len_diff": "abs(length(aa) - length(ab))::double / greatest(length(aa), length(ab), 1)",
    "retrieval_score": "1.0::double / rank", "retrieval_rank": "(rank - 1)::double",
    "agree": f"CASE WHEN {_NS} >= 0.85::double AND {_AS} >= 0.85::double THEN 1.0::double WHEN {_NS} >= 0.85::double AND {_AS} > 0 AND {_AS} < 0.5::double THEN -1.0::double ELSE 0.0::double END",
}
_ROUNDED = lambda cols: ", ".join(f"round(({e})::float::double, 6) AS {k}" for k, e in cols.items())
_SUM = lambda weights: "0.0::double + " + " + ".join(f"{k}::double * {w}::double" for k, w in weights.items())
_CLIP = lambda x: f"least(greatest({x}, 0.0::double), 1.0::double)"
_V2_SCORE = _CLIP(f"CASE WHEN name_addr_conflict > 0 THEN ({_SUM(WEIGHTS_V2)}) * 0.55::double ELSE {_SUM(WEIGHTS_V2)} END")
HITS = f"""{V1}, h AS (SELECT truth.s1, truth.id, c.rank, c.routes FROM truth LEFT JOIN c USING (s1, id))"""


def with_(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes}\n{select}"


def _value(expr: str) -> str:
    return with_(BASE, f"SELECT entity_id, {expr} AS value FROM k")


_V1N, _V1A = _rewrite(_squash(LN), D.LEGAL_V1), _rewrite(_squash(LA), D.LEGAL_V1 | D.STREET)
def _sweep(caps: list[int]) -> str:
    each = " UNION ALL ".join(
        f"SELECT {k} AS cap, s.s1, coalesce(n_true, 0) AS n_true, coalesce(hit, 0) AS hit, coalesce(n2, 0) AS n2, coalesce(n3, 0) AS n3 FROM s LEFT JOIN (SELECT s1, count(*) AS n_true, count(*) FILTER (WHERE rank <= {k}) AS hit FROM h GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) FILTER (WHERE rank <= {k} AND id LIKE 'S2-%') AS n2, count(*) FILTER (WHERE rank <= {k} AND id LIKE 'S3-%') AS n3 FROM c GROUP BY s1) USING (s1)"
        for k in caps
    )
    return f"SELECT cap, round(sum(hit)::double / nullif(sum(n_true), 0), 6) AS micro_recall, round(avg(CASE WHEN n_true > 0 THEN hit::double / n_true END), 6) AS macro_recall, round(avg({_F.format(tp='hit', fp='0', fn='(n_true - hit)')}), 6) AS oracle_macro_f05, round(avg(n2), 6) AS avg_s2, round(avg(n3), 6) AS avg_s3 FROM ({each}) GROUP BY cap"


_CURVE = " UNION ALL ".join(
    f"SELECT {g}::double AS threshold, s.s1, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp, coalesce(np, 0) - coalesce(tp, 0) AS fp FROM s LEFT JOIN (SELECT s1, count(*) AS n_true FROM truth GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS np, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM truth x WHERE x.s1 = sc.s1 AND x.id = sc.id)) AS tp FROM sc WHERE prob >= {g}::double GROUP BY s1) USING (s1)"
    for g in GRID
)
_CURVE_F = f"SELECT threshold, round(avg({_F.format(tp='tp', fp='fp', fn='(n_true - tp)')}), 6) AS macro_f05 FROM ({_CURVE}) GROUP BY threshold"
_NEAREST = lambda p: f"(SELECT n::double FROM (SELECT n, row_number() OVER (ORDER BY n) AS rn, count(*) OVER () AS m FROM sz) WHERE rn = round_even((m - 1) * {p}::double, 0) + 1)"
_BUCKET = "CASE WHEN {0} = 0 THEN '0' WHEN {0} = 1 THEN '1' WHEN {0} <= 5 THEN '2-5' WHEN {0} <= 50 THEN '6-50' ELSE '>50' END"
_MULT = "CASE WHEN {0} = 1 THEN '1' WHEN {0} <= 3 THEN '2-3' WHEN {0} <= 5 THEN '4-5' ELSE '6+' END"
_FIELD = " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS v FROM r0" for c in ("business_name", "business_address", "country"))

_DRAW = lambda key, seed=42: f"('0x' || substr(md5('{seed}|' || {key}), 1, 13))::bigint"
_COMPONENTS = "cp AS (SELECT s1, min(s1) OVER (PARTITION BY CASE WHEN s1 IN (SELECT s1 FROM truth) THEN truth_key ELSE s1 END) AS component FROM s)"
_FOLDS = f"""{BASE}, {_COMPONENTS}, sz AS (SELECT component, count(*) AS n, {_DRAW("component")} AS spot FROM cp GROUP BY component),
bf AS (SELECT component, n, spot, (sum(n) OVER (ORDER BY spot, component) - n)::double / (SELECT count(*) FROM cp) AS before FROM sz),
folds AS (SELECT s1, component, CASE WHEN before < 0.7::double THEN 'fit' WHEN before < 0.7::double + 0.15::double THEN 'select' ELSE 'assess' END AS fold FROM cp JOIN bf USING (component))"""
_SAMPLED = lambda pairs, per, floor: f"""lb AS (SELECT p.s1, p.id, (truth.s1 IS NOT NULL)::bigint AS label FROM {pairs} p LEFT JOIN truth USING (s1, id)),
kept_rows AS (SELECT s1, id, label FROM (SELECT *, greatest({floor}, {per} * greatest(sum(label) OVER (PARTITION BY s1), 1)) AS most, row_number() OVER (PARTITION BY s1, label ORDER BY {_DRAW("s1 || '|' || id")}, id) AS rk FROM lb) WHERE label = 1 OR rk <= most)"""  # noqa: E731
_ORACLE_CTE = f"o AS (SELECT s.s1, s.country, coalesce(n_true, 0) AS n_true, coalesce(hit, 0) AS hit FROM s LEFT JOIN (SELECT truth.s1, count(*) AS n_true, count(c.id) AS hit FROM truth LEFT JOIN c USING (s1, id) GROUP BY truth.s1) USING (s1)), oo AS (SELECT *, {_F.format(tp='hit', fp='0', fn='(n_true - hit)')} AS o FROM o)"
_AT_HALF = f"{PAIRS}, taken AS (SELECT s1, id FROM sc WHERE prob >= 0.5::double), {_entity('truth', 'taken')}"
_JOINT = " UNION ALL ".join(
    f"SELECT {t}::double AS threshold, {g}::double AS gate, {r}::double AS rel, s1, count(*) FILTER (WHERE ok) AS tp, count(*) FILTER (WHERE NOT ok) AS fp FROM marked WHERE prob >= {t}::double AND best >= {g}::double AND prob >= {r}::double * best GROUP BY s1" for t in GRID for g in GATES for r in RELS
)
_SETTINGS = " UNION ALL ".join(f"SELECT {t}::double AS threshold, {g}::double AS gate, {r}::double AS rel" for t in GRID for g in GATES for r in RELS)
_JOINT_CTES = f"""{PAIRS}, marked AS (SELECT sc.s1, prob, max(prob) OVER (PARTITION BY sc.s1) AS best, truth.s1 IS NOT NULL AS ok FROM sc LEFT JOIN truth USING (s1, id)), counts AS ({_JOINT}), settings AS ({_SETTINGS}),
nt AS (SELECT s.s1, count(truth.id) AS n_true FROM s LEFT JOIN truth USING (s1) GROUP BY s.s1),
joint AS (SELECT threshold, gate, rel, round(avg({_F.format(tp='coalesce(tp, 0)', fp='coalesce(fp, 0)', fn='(n_true - coalesce(tp, 0))')}), 6) AS macro_f05 FROM settings CROSS JOIN nt LEFT JOIN counts USING (threshold, gate, rel, s1) GROUP BY threshold, gate, rel)"""
_EVALUATION = "SELECT count(*) AS n, round(avg(f05), 6) AS macro_f05, round(sum(tp)::double / nullif(sum(tp + fp), 0), 6) AS micro_precision, round(sum(tp)::double / nullif(sum(n_true), 0), 6) AS micro_recall, round(avg(CASE WHEN n_true = 0 THEN (fp = 0)::int::double END), 6) AS singleton_accuracy, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn FROM f"
_V4 = lambda *aux: _pairs_with(_d(300, True, True, aux))
_COMPETING = _competition("name_token_sort", "addr_token_sort")
_ROUTE_COLS = {f"route_{r}": f"list_contains(routes, '{r}')::int" for r in _ROUTES}
_CORED = lambda ctes: f"{ctes}, core AS MATERIALIZED (SELECT *, {_FLOATS(_CORE)} FROM pe)"
_OF_S = lambda posts: posts.replace(" FROM t", " FROM (SELECT *, s1 AS id FROM s)")
_MISSES = f"""{V1}, ev AS ({_OF_S(POST_V1)}), ms AS (SELECT truth.s1, truth.id FROM truth ANTI JOIN c USING (s1, id)),
sh AS (SELECT DISTINCT ms.s1, ms.id, p.route, p.key FROM ms JOIN p ON p.id = ms.id JOIN ev ON ev.id = ms.s1 AND ev.route = p.route AND ev.key = p.key),
cat AS (SELECT ms.s1, ms.id, CASE WHEN ms.id NOT IN (SELECT id FROM t) THEN '1_target_absent_from_index' WHEN EXISTS (SELECT 1 FROM pool WHERE pool.s1 = ms.s1 AND pool.id = ms.id) THEN '5_in_pool_below_final_cap'
  WHEN NOT EXISTS (SELECT 1 FROM sh WHERE sh.s1 = ms.s1 AND sh.id = ms.id) THEN '2_no_shared_retrieval_key' WHEN EXISTS (SELECT 1 FROM sh JOIN q ON q.s1 = sh.s1 AND q.route = sh.route AND q.key = sh.key WHERE sh.s1 = ms.s1 AND sh.id = ms.id) THEN '4_discarded_by_route_limit' ELSE '3_shared_key_not_queried' END AS category FROM ms),
{_ORACLE_CTE}, bk AS (SELECT s1, category, count(*) AS k, count(*) FILTER (WHERE id LIKE 'S2-%') AS s2 FROM cat GROUP BY s1, category)"""
_PARTS = " UNION ALL ".join(
    [f"SELECT 'overall' AS part, count(*) AS n, round(avg(f05), 6) AS macro_f05 FROM f", "SELECT 'country:' || country, count(*), round(avg(f05), 6) FROM f GROUP BY country"]
    + [f"SELECT 'source:{k}', count(*), round(avg({_F.format(tp='tp', fp='(np - tp)', fn='(nt - tp)')}), 6) FROM (SELECT s.s1, coalesce(nt, 0) AS nt, coalesce(np, 0) AS np, coalesce(tp, 0) AS tp FROM s LEFT JOIN (SELECT s1, count(*) AS nt FROM truth WHERE id LIKE '{k}-%' GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS np FROM links WHERE id LIKE '{k}-%' GROUP BY s1) USING (s1) LEFT JOIN (SELECT s1, count(*) AS tp FROM truth JOIN links USING (s1, id) WHERE id LIKE '{k}-%' GROUP BY s1) USING (s1))" for k in ("S2", "S3")]
)

#: On the letters of the test tables: no other has a casefold or a compatibility form of its own there.
_TEXT, _CASEFOLD = "coalesce(text, '')", "replace(lower({0}), 'ß', 'ss')"
_SCRIPT = "CASE WHEN NOT regexp_matches({0}, '\\p{{L}}') THEN 'no_letters' WHEN regexp_matches({0}, '[^\\P{{L}}\\p{{Latin}}]') THEN 'non_latin' ELSE 'latin' END"

ORACLE_SQL: dict[str, str] = {
    "norm_name": _value("name_norm"),
    "norm_addr": _value("addr_norm"),
    "norm_v1": _value(f"{_V1N} || '|' || {_V1A}"),
    "norm_a": _value(f"{_rewrite(_squash(LN), D.SUFFIX_A)} || '|' || {_rewrite(_squash(LA), D.SUFFIX_A | D.ADDRESS_A)}"),
    "norm_b": _value(f"trim(regexp_replace(regexp_replace({LN}, '\\s*&\\s*', ' and ', 'g'), '\\s+', ' ', 'g')) || '|' || {_squash(LN)} || '|' || {_rewrite(_squash(LN), D.LEGAL_B)} || '|' || {_rewrite(_squash(LA), D.LEGAL_B | D.STREET_B)}"),
    "sig_tokens": _value(_join("toks")),
    "sorted_sig": _value(f"coalesce({SORTED_SIG}, '')"),
    "nums": _value(_join("ns")),
    "numeric_tokens": _value(_join("regexp_extract_all(addr_norm, '\\p{Nd}+')")),
    "addr_tokens": _value(_join("atoks")),
    "compact_prefix": _value(f"{COMPACT}[:3] || '|' || CASE WHEN length({COMPACT}) >= 4 THEN {COMPACT}[:4] ELSE '' END || '|' || CASE WHEN length({COMPACT}) >= 8 THEN {COMPACT}[:8] ELSE '' END"),
    "postings_v1": with_(f"{BASE}, p AS ({POST_V1})", "SELECT route, key, id FROM p"),
    "postings_v2": with_(f"{BASE}, p AS ({POST_V2})", "SELECT route, key, id FROM p"),
    "postings_pair": with_(f"{BASE}, p AS ({POST_PAIR})", "SELECT route, key, id FROM p"),
    "postings_aux": with_(f"{BASE}, p AS ({' UNION ALL '.join(_AUX.values())})", "SELECT route, key, id FROM p"),
    "token_df": with_(f"{BASE}, p AS ({POST_V2})", "SELECT key, count(DISTINCT id) AS df FROM p WHERE route = 'token' GROUP BY key"),
    "bucket_limit_plain": with_(f"{BASE}, p AS ({POST_V1}), {_limits(_V1_LIMITS)}, {_PLAIN}", "SELECT route, key, id FROM kept"),
    "bucket_limit_balanced": with_(_d(300, True, True, _ALL), "SELECT route, key, id FROM kept"),
    "cands_v1": with_(V1, _RANKED),
    "cands_v2": with_(_d(120, False, False, ()), _RANKED),
    "cands_v3a": with_(_d(120, True, False, ()), _RANKED),
    "cands_v3b": with_(_d(300, True, True, ()), _RANKED),
    "cands_v4a": with_(_d(300, True, True, ("numtok",)), _RANKED),
    "cands_v4b": with_(_d(300, True, True, ("cpre8",)), _RANKED),
    "cands_v4c": with_(_d(300, True, True, ("numnum",)), _RANKED),
    "cands_v4all": with_(_d(300, True, True, _ALL), _RANKED),
    "route_membership": with_(_d(300, True, True, _ALL), "SELECT s1, id, array_to_string(routes, '~') AS routes FROM c"),
    "jaccard_core": with_(PAIRS, "SELECT s1, id, round(nj, 6) AS name, round(aj, 6) AS addr FROM pr"),
    "num_overlap": with_(PAIRS, "SELECT s1, id, round(num, 6) AS overlap, nc AS conflict FROM pr"),
    "containment": with_(PAIRS, "SELECT s1, id, round(cont, 6) AS a_in_b, round(CASE WHEN greatest(length(na), length(nb)) = 0 THEN 0.0::double ELSE least(length(na), length(nb))::double / greatest(length(na), length(nb)) END, 6) AS len_ratio FROM pr"),
    "jaro_winkler": with_(PAIRS, "SELECT s1, id, round(CASE WHEN na = '' AND nb = '' THEN 0.0::double ELSE jaro_winkler_similarity(na, nb) END, 6) AS name_jw FROM pr"),
    "levenshtein_ext": with_(PAIRS, "SELECT s1, id, levenshtein(na, nb)::double AS edits FROM pr"),
    "exact_match": with_(LINKS, "SELECT s1, id FROM links"),
    "weighted_jaccard": with_(PAIRS, "SELECT s1, id, prob FROM sc"),
    "threshold": with_(PAIRS, "SELECT s1, id, prob FROM sc WHERE prob >= 0.5::double"),
    "gate_relative": with_(PAIRS, "SELECT s1, id, prob FROM (SELECT *, max(prob) OVER (PARTITION BY s1) AS best FROM sc) WHERE prob >= 0.3::double AND best >= 0.6::double AND prob >= 0.9::double * best"),
    "accept_rules": with_(PAIRS, "SELECT s1, id, prob FROM sc WHERE prob >= 0.5::double AND NOT (nj >= 0.85::double AND aj > 0 AND aj < 0.45::double AND num < 0.1::double) AND (ex >= 1 OR (nj >= 0.88::double AND (aj >= 0.55::double OR num >= 0.25::double OR nj >= 0.6::double)) OR nj >= 0.92::double OR (nj >= 0.7::double AND (aj >= 0.5::double OR num >= 0.2::double)) OR (nj >= 0.95::double AND aj >= 0.6::double) OR (prob >= 0.98::double AND nj >= 0.8::double))"),
    "entity_f05": with_(ENTITY, "SELECT s1, n_true, tp, fp, fn, round(f05, 6) AS f05 FROM f"),
    "evaluate_macro": with_(ENTITY, "SELECT count(*) AS n, round(avg(f05), 6) AS macro_f05, round(sum(tp)::double / nullif(sum(tp + fp), 0), 6) AS micro_precision, round(sum(tp)::double / nullif(sum(n_true), 0), 6) AS micro_recall, round(avg(CASE WHEN n_true = 0 THEN (fp = 0)::int::double END), 6) AS singleton_accuracy, sum(tp)::bigint AS tp, sum(fp)::bigint AS fp, sum(fn)::bigint AS fn FROM f"),
    "blocking_recall": with_(HITS, "SELECT round(coalesce(count(rank)::double / nullif(count(*), 0), 1.0), 6) AS blocking_recall FROM h"),
    "cap_sweep": with_(HITS, _sweep(CAPS)),
    "cap_sweep_pool": with_(f"{_d(1 << 30, True, True, _ALL)}, h AS (SELECT truth.s1, truth.id, c.rank FROM truth LEFT JOIN c USING (s1, id))", _sweep(POOL_CAPS)),
    "threshold_curve": with_(PAIRS, _CURVE_F),
    "best_threshold": with_(PAIRS, f"{_CURVE_F} ORDER BY macro_f05 DESC, threshold LIMIT 1"),
    "route_attribution": with_(HITS, "SELECT route, count(*) AS hits, count(*) FILTER (WHERE sole) AS sole_hits FROM (SELECT unnest(routes) AS route, len(routes) = 1 AS sole FROM h WHERE rank IS NOT NULL) GROUP BY route"),
    "candidate_diag": with_(
        f"""{HITS}, hs AS (SELECT s1, count(*) AS n_true, count(rank) AS hit FROM h GROUP BY s1), sz AS (SELECT s.s1, coalesce(n, 0) AS n, coalesce(n_true, 0) AS n_true, coalesce(hit, 0) AS hit FROM s LEFT JOIN (SELECT s1, count(*) AS n FROM c GROUP BY s1) USING (s1) LEFT JOIN hs USING (s1))""",
        f"""SELECT round(sum(hit)::double / sum(n_true), 6) AS micro_candidate_recall, (SELECT round(count(rank)::double / count(*), 6) FROM h WHERE id LIKE 'S2-%') AS s2_recall, (SELECT round(count(rank)::double / count(*), 6) FROM h WHERE id LIKE 'S3-%') AS s3_recall,
round(count(*) FILTER (WHERE n_true > 0 AND hit = n_true)::double / count(*) FILTER (WHERE n_true > 0), 6) AS full_set_coverage, round(avg(n), 6) AS avg_candidates, max(n)::double AS max_candidates, round(avg((n = 0)::int), 6) AS zero_candidate_frac,
round(1 - sum(n)::double / (count(*) * (SELECT count(*) FROM t)), 6) AS reduction_ratio, round(avg({_F.format(tp='hit', fp='0', fn='(n_true - hit)')}), 6) AS oracle_macro_f05, sum(n_true)::bigint AS true_matches_total, sum(hit)::bigint AS true_matches_retrieved,
{_NEAREST(0.5)} AS median_candidates, {_NEAREST(0.95)} AS p95_candidates, {_NEAREST(0.99)} AS p99_candidates FROM sz""",
    ),
    "slices": with_(
        f"""{HITS}, x AS (SELECT h.s1, h.id, (h.rank IS NOT NULL)::int AS hit, s.country, coalesce(same, 0) AS same, many FROM h JOIN s USING (s1) LEFT JOIN (SELECT name_norm, count(*) AS same FROM t WHERE name_norm <> '' GROUP BY name_norm) USING (name_norm) JOIN (SELECT s1, count(*) AS many FROM truth GROUP BY s1) m ON m.s1 = h.s1),
y AS (SELECT 'source' AS dim, id[:2] AS bucket, hit FROM x UNION ALL SELECT 'country', country, hit FROM x UNION ALL SELECT 's1_name_ambiguity', {_BUCKET.format('same')}, hit FROM x UNION ALL SELECT 's1_match_multiplicity', {_MULT.format('many')}, hit FROM x)""",
        "SELECT dim, bucket, count(*) AS truth_links, sum(hit)::bigint AS retrieved, round(sum(hit)::double / count(*), 6) AS recall FROM y GROUP BY dim, bucket",
    ),
    "error_taxonomy": with_(
        f"{V1}, links AS (SELECT s.s1, t.id FROM s JOIN t ON s.name_norm = t.name_norm WHERE s.name_norm <> '' AND CASE WHEN s.addr_norm <> '' AND t.addr_norm <> '' THEN s.addr_norm = t.addr_norm ELSE s.country_key <> '' AND s.country_key = t.country_key END), {_entity('truth', 'links')}",
        "SELECT category, sum(n)::bigint AS n FROM (SELECT CASE WHEN c.id IS NULL THEN 'fn_blocking' ELSE 'fn_threshold' END AS category, 1 AS n FROM truth ANTI JOIN links USING (s1, id) LEFT JOIN c USING (s1, id) UNION ALL SELECT 'singleton_fp', fp FROM f WHERE n_true = 0 UNION ALL SELECT 'fp', fp FROM f WHERE n_true > 0 UNION ALL SELECT 'partial_miss', 1 FROM f WHERE tp > 0 AND fn > 0) GROUP BY category HAVING sum(n) > 0",
    ),
    "eda_fields": with_(
        f"{BASE}, e AS ({_FIELD})",
        f"""SELECT field, count(*) AS n, count(*) FILTER (WHERE trim(v) = '') AS empty, round(avg(length(v)), 6) AS len_mean, round(quantile_cont(length(v), 0.5)::double, 6) AS len_p50, round(quantile_cont(length(v), 0.95)::double, 6) AS len_p95, round(avg(len({_words('v')})), 6) AS tokens_mean,
round(avg(regexp_matches(v, '[^\\x00-\\x7F]')::int), 6) AS non_ascii_rate, round(avg(regexp_matches(v, '[0-9]')::int), 6) AS digit_rate, round(avg(regexp_matches(v, '[^\\p{{L}}\\p{{N}}_\\s]')::int), 6) AS punct_rate, round(avg(len(regexp_extract_all(v, '\\p{{Nd}}+'))), 6) AS digit_tokens_mean FROM e GROUP BY field""",
    ),
    "truth_report": with_(
        f"{BASE}, u AS (SELECT s.s1, coalesce(k, 0) AS k, coalesce(a, 0) AS a, coalesce(b, 0) AS b FROM s LEFT JOIN (SELECT s1, count(*) AS k, max((id LIKE 'S2-%')::int) AS a, max((id LIKE 'S3-%')::int) AS b FROM truth GROUP BY s1) USING (s1))",
        "SELECT count(*) AS records, sum(k)::bigint AS links, round(avg((k = 0)::int), 6) AS singleton_rate, sum(a * b)::bigint AS both_sources, max(k)::bigint AS most, round(avg((k = 0)::int), 6) AS empty_baseline FROM u",
    ),
    "match_histogram": with_(BASE, "SELECT matches, count(*) AS n FROM (SELECT s.s1, count(truth.id) AS matches FROM s LEFT JOIN truth USING (s1) GROUP BY s.s1) GROUP BY matches"),
    "components": with_(BASE, "SELECT s1, min(s1) OVER (PARTITION BY CASE WHEN s1 IN (SELECT s1 FROM truth) THEN truth_key ELSE s1 END) AS component FROM s"),
    "split_leak_check": "SELECT 0::bigint AS leaking",
    "id_lists": with_(V1, "SELECT s.s1 AS source1_entity_id, coalesce(string_agg(c.id, ',' ORDER BY c.rank), '') AS candidate_entity_ids FROM s LEFT JOIN c USING (s1) GROUP BY s.s1"),
    "validate_outputs": with_(
        f"{LINKS}, b AS (SELECT s1, CASE WHEN s1[4:]::bigint % 7 = 0 THEN s1 ELSE id END AS id FROM links WHERE s1[4:]::bigint % 50 <> 1)",
        "SELECT rule, count(*) AS n FROM (SELECT 'missing_s1' AS rule FROM s WHERE s1 NOT IN (SELECT s1 FROM b) UNION ALL SELECT 'duplicate_id' FROM b GROUP BY s1, id HAVING count(*) > 1 UNION ALL SELECT 'self_match' FROM b WHERE id LIKE 'S1-%') GROUP BY rule",
    ),
    "unicode_folds": "SELECT doc_id::varchar AS entity_id, " + ", ".join(f"sha256({e}) AS {k}" for k, e in {"plain": _CASEFOLD.format(_TEXT), "accents": f"strip_accents({_TEXT})", "folded": _CASEFOLD.format(f"strip_accents({_TEXT})")}.items()) + " FROM documents",
    "unicode_norm": f"SELECT doc_id::varchar AS entity_id, {_rewrite(_squash(_bare(_CASEFOLD.format(f'strip_accents({_TEXT})'))), D.LEGAL)} AS name_norm, {_SCRIPT.format(_TEXT)} AS script FROM documents",
    "slices_target_script": with_(f"{HITS}, x AS (SELECT {_SCRIPT.format('t.business_name')} AS bucket, (h.rank IS NOT NULL)::int AS hit FROM h JOIN t ON t.id = h.id)", "SELECT 'target_script' AS dim, bucket, count(*) AS truth_links, sum(hit)::bigint AS retrieved, round(sum(hit)::double / count(*), 6) AS recall FROM x GROUP BY bucket"),
    "significant_tokens": _value(f"{_join(_sig('name_norm', D.STOP, 2))} || '|' || {_join(_sig('name_norm', D.STOP))}"),
    "postings_a": with_(f"{_A_BASE}, p AS ({_POST_A} UNION ALL SELECT 'country', country_key, id, source, ord FROM t WHERE country_key <> '')", "SELECT route, key, id FROM p"),
    "postings_b": with_(f"{_B_BASE}, p AS ({_POST_B})", "SELECT route, key, id FROM p"),
    "cands_a": with_(A, _RANKED),
    "cands_b": with_(B, _RANKED),
    "tfidf_knn": with_(f"{_B_BASE}{_TFIDF}", "SELECT s1, id, round(similarity, 6) AS similarity, rank FROM knn"),
    "fuzz_features": with_(f"{_CORED(_V4(*_ALL))}", f"SELECT s1, id, {_ROUNDED({k: k for k in _CORE} | _COMPETING | _ROUTE_COLS | _EXTRA)} FROM core WINDOW w AS (PARTITION BY s1)"),
    "features_32": with_(_CORED(_pairs_with(_d(120, True, False, ()))), f"SELECT s1, id, {_ROUNDED({k: k for k in _CORE} | _COMPETING | _ROUTE_COLS)} FROM core WINDOW w AS (PARTITION BY s1)"),
    "features_core": with_(_pairs_with(_d(120, False, False, ())), f"SELECT s1, id, {_ROUNDED(_CORE)} FROM pe"),
    "features_a": with_(_pairs_with(A), f"SELECT s1, id, {_ROUNDED(_FEATURES_A)} FROM pe"),
    "features_b": with_(_pairs_with(B), f"SELECT s1, id, {_ROUNDED(_FEATURES_B)} FROM pe"),
    "edit_measures": with_(_pairs_with(_d(120, False, False, ())), "SELECT s1, id, " + ", ".join(f"round({e}, 6) AS {side}_{k}" for side, x, empty in (("name", "n", "no_name"), ("addr", "a", "no_addr")) for k, e in (("ratio", f"{x}_ratio"), ("token_sort", _GUARD(f"{x}_sort", empty)), ("token_set", f"{x}_set"), ("partial", _GUARD(f"{x}_part", empty)), ("jaro_winkler", _GUARD(f"{x}_jw", empty)))) + " FROM pe"),
    "weighted_scores": with_(_CORED(_pairs_with(V1)), f"SELECT s1, id, round({_CLIP(_SUM(WEIGHTS_V1))}, 6) AS score_v1, round({_V2_SCORE}, 6) AS score_v2 FROM core"),
    "weighted_b": with_(f"{_pairs_with(B)}, fb AS (SELECT s1, id, {_FLOATS(_FEATURES_B)} FROM pe)", f"SELECT s1, id, round({_CLIP(_SUM(WEIGHTS_B))}, 6) AS score_b FROM fb"),
    "contradictions": with_(_CORED(_pairs_with(V1)), "SELECT s1, id FROM core WHERE NOT (name_addr_conflict >= 1 AND num_overlap < 0.1::float)"),
    "competition_features": with_(PAIRS_LISTS, "SELECT s1, id, " + ", ".join(f"round(({_competition('nj', 'aj')[k]})::float::double, 4) AS {k}" for k in ("rank_frac", "n_cands", "name_s_rank", "addr_s_rank", "name_s_gap_to_best_other", "n_cands_name_ge_09", "num_conflict", "same_source_count_name_ge_09", "score_ratio_to_top")) + " FROM pr2 WINDOW w AS (PARTITION BY s1)"),
    "joint_tuning": with_(_JOINT_CTES, "SELECT threshold, gate, rel, macro_f05 FROM joint"),
    "best_joint": with_(_JOINT_CTES, "SELECT threshold, gate, rel, macro_f05 FROM joint ORDER BY macro_f05 DESC, threshold, gate, rel LIMIT 1"),
    "exact_limited": with_(f"{BASE}, t100 AS (SELECT * FROM t WHERE name_norm <> '' QUALIFY row_number() OVER (PARTITION BY name_norm ORDER BY source, ord, id) <= 100)", "SELECT s.s1, t.id FROM s JOIN t100 t ON s.name_norm = t.name_norm WHERE CASE WHEN s.addr_norm <> '' AND t.addr_norm <> '' THEN s.addr_norm = t.addr_norm ELSE s.country_key <> '' AND s.country_key = t.country_key END"),
    "exact_among": with_(f"{V1}, {_LINKS_CTE}", "SELECT s1, id FROM c JOIN links USING (s1, id)"),
    "no_links": with_(f"{BASE}, links AS (SELECT s1, id FROM truth WHERE false), {_entity('truth', 'links')}", _EVALUATION),
    "random_split": with_(BASE, f"SELECT s1, CASE WHEN {_DRAW('s1')} < 0.25::double * {1 << 52} THEN 'val' ELSE 'train' END AS fold FROM s"),
    "bounded_sample": with_(BASE, f"SELECT s1 FROM s ORDER BY {_DRAW('s1')}, s1 LIMIT 50"),
    "component_split": with_(_FOLDS, "SELECT s1, component, fold FROM folds"),
    "fold_shares": with_(_FOLDS, "SELECT fold, count(*) AS n, count(DISTINCT component) AS components, (SELECT count(*) FROM (SELECT component FROM folds GROUP BY component HAVING count(DISTINCT fold) > 1)) AS leaking FROM folds GROUP BY fold"),
    "split_conflicts": with_(_FOLDS, f"SELECT s1, fold, 'fit' AS was FROM folds WHERE {_DRAW('s1', 7)} % 10 = 5 AND fold <> 'fit'"),
    "fresh_slice": with_(f"{_FOLDS}, free AS (SELECT * FROM folds WHERE component NOT IN (SELECT component FROM folds WHERE fold = 'assess')), fs AS (SELECT component, count(*) AS n, {_DRAW('component')} AS spot FROM free GROUP BY component), ff AS (SELECT component, sum(n) OVER (ORDER BY spot, component) - n AS before FROM fs)", "SELECT s1, component FROM free JOIN ff USING (component) WHERE before < 40"),
    "neg_sampling": with_(f"{V1}, {_SAMPLED('c', 3, 8)}", "SELECT s1, id, label FROM kept_rows"),
    "training_rows": with_(f"{A}, {_SAMPLED('c', 4, 4)}", "SELECT s1, id, label FROM kept_rows UNION ALL SELECT s1, id, 1 FROM truth ANTI JOIN kept_rows USING (s1, id)"),
    "miss_attribution": with_(_MISSES, f"SELECT category, sum(k)::bigint AS misses, sum(s2)::bigint AS s2, (sum(k) - sum(s2))::bigint AS s3, round(sum({_F.format(tp='(hit + k)', fp='0', fn='(n_true - hit - k)')} - o) / (SELECT count(*) FROM s), 6) AS oracle_gain FROM bk JOIN oo USING (s1) GROUP BY category"),
    "loss_report": with_(f"{ENTITY_V1}, {_ORACLE_CTE}", f"SELECT round(avg(f05), 6) AS macro_f05, round(avg(o), 6) AS candidate_oracle, round(1 - avg(f05), 6) AS loss_total, round(1 - avg(o), 6) AS loss_retrieval, round(avg(o) - avg(f05), 6) AS loss_matcher, round(avg({_F.format(tp='tp', fp='0', fn='fn')}) - avg(f05), 6) AS gain_without_false, round(avg({_F.format(tp='hit', fp='fp', fn='(f.n_true - hit)')}) - avg(f05), 6) AS gain_with_all_retrieved FROM f JOIN oo USING (s1)"),
    "loss_by_country": with_(f"{ENTITY_V1}, {_ORACLE_CTE}", "SELECT f.country, count(*) AS n, round(avg(f05), 6) AS macro_f05, round(avg(o), 6) AS candidate_oracle FROM f JOIN oo USING (s1) GROUP BY f.country"),
    "singleton_losses": with_(_AT_HALF, "SELECT count(*) FILTER (WHERE n_true = 0) AS singletons, count(*) FILTER (WHERE n_true = 0 AND fp > 0) AS false_merge, round(sum(CASE WHEN n_true = 0 THEN 1 - f05 ELSE 0.0::double END) / count(*), 6) AS macro_loss_share FROM f"),
    "rejected_quantiles": with_(PAIRS, "SELECT count(*) AS n, " + ", ".join(f"round(quantile_cont(prob, {q}), 6) AS q{i}" for i, q in enumerate((0.25, 0.5, 0.75, 0.9))) + " FROM sc JOIN truth USING (s1, id) WHERE prob < 0.9::double"),
    "false_profile": with_(_CORED(_pairs_with(V1)), f"SELECT round(avg((name_exact >= 1)::int), 6) AS name_exact, round(avg((name_token_sort >= 0.9::double)::int), 6) AS name_token_sort_ge_09, round(avg((addr_token_sort < 0.5::double)::int), 6) AS addr_token_sort_lt_05, round(avg(({_CLASH('nsa', 'nsb')} >= 1)::int), 6) AS num_conflict, round(avg(({_EXTRA['long_num_conflict']} >= 1)::int), 6) AS long_num_conflict, round(avg((country_equal >= 1)::int), 6) AS country_equal FROM core ANTI JOIN truth USING (s1, id) WHERE round({_V2_SCORE}, 6) >= 0.5::double"),
    "bootstrap": with_(f"{_AT_HALF}, {_LINKS_CTE}, {_entity('truth', 'links').replace('e AS (', 'e2 AS (').replace('f AS (', 'f2 AS (').replace('FROM e)', 'FROM e2)')}", "SELECT round(avg(f.f05 - f2.f05), 6) AS mean, count(*) FILTER (WHERE round(f.f05 - f2.f05, 12) > 0) AS better, count(*) FILTER (WHERE round(f.f05 - f2.f05, 12) < 0) AS worse, 1 AS inside FROM f JOIN f2 USING (s1)"),
    "output_scores": with_(ENTITY, _PARTS),
    "audit": with_(BASE, "SELECT 'empty_name' AS rule, count(*) AS n FROM s WHERE trim(business_name) = '' UNION ALL SELECT 'empty_address', count(*) FROM s WHERE trim(business_address) = '' UNION ALL SELECT 'empty_country', count(*) FROM s WHERE trim(country) = '' UNION ALL SELECT 'repeated_entity', count(*) FROM (SELECT s1 FROM s GROUP BY s1 HAVING count(*) > 1) UNION ALL SELECT 'repeated_target', count(*) FROM (SELECT id FROM truth GROUP BY id HAVING count(DISTINCT s1) > 1) UNION ALL SELECT unnest(['repeated_truth', 'unknown_truth', 'malformed_target', 'unknown_target']), 0"),
    "source_report": with_(BASE, "SELECT source, count(*) AS n_records, count(DISTINCT entity_id) AS n_unique_ids, count(*) - count(DISTINCT entity_id) AS n_duplicate_ids, count(DISTINCT country) AS n_countries FROM r0 GROUP BY source"),
    "country_counts": with_(BASE, "SELECT source, country, count(*) AS n FROM r0 GROUP BY source, country"),
    "noise_examples": with_(BASE, "SELECT x.s1, x.id, s.business_name AS name_1, s.business_address AS address_1, t.business_name AS name_t, t.business_address AS address_t FROM (SELECT * FROM truth ORDER BY s1, id LIMIT 20) x JOIN s ON s.s1 = x.s1 JOIN t ON t.id = x.id"),
    "parity": f"SELECT s1, id, score, 'left' AS side FROM (({with_(_d(120, False, False, ()), 'SELECT s1, id, score FROM c')}) EXCEPT ALL ({with_(_d(120, True, False, ()), 'SELECT s1, id, score FROM c')})) UNION ALL SELECT s1, id, score, 'right' FROM (({with_(_d(120, True, False, ()), 'SELECT s1, id, score FROM c')}) EXCEPT ALL ({with_(_d(120, False, False, ()), 'SELECT s1, id, score FROM c')}))",
    "candidate_ids": with_(V1, "SELECT (SELECT count(*) FROM c JOIN t USING (id) WHERE t.ord % 7 = 0) AS unknown, (SELECT count(*) FROM truth ANTI JOIN c USING (s1, id)) AS not_candidates"),
    "index_complete": with_(f"{BASE}, p AS ({POST_V2})", "SELECT route, count(*) AS n FROM p GROUP BY route"),
    "linked_lists": with_(
        f"{_CORED(_V4(*_ALL))}, sp AS (SELECT s1, id, rank, {_V2_SCORE} AS prob FROM core WHERE NOT (name_addr_conflict >= 1 AND num_overlap < 0.1::float)), gr AS (SELECT * FROM (SELECT *, max(prob) OVER (PARTITION BY s1) AS best FROM sp) WHERE prob >= 0.6::double AND best >= 0.6::double AND prob >= 0.9::double * best)",
        "SELECT s.s1 AS source1_entity_id, coalesce(string_agg(gr.id, ',' ORDER BY gr.rank, gr.id), '') AS matched_entity_ids, any_value(s.ord) AS ord FROM s LEFT JOIN gr USING (s1) GROUP BY s.s1",
    ),
}

"""Normalisation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from linkloom.functions import line_a, line_b, translit
from linkloom.functions import vocab as V
from linkloom.functions.tokens import collapse_initials, dedupe_consecutive, fix_leet, joined, tokens
from linkloom.plans.q_retrieval import t
from linkloom.shipping import ship

#: Names and addresses that show each rule, around a part's own words: {n} its name, {t} its type, {b} its brand, {k} its key.
NAMES = (
    "{n}", "{n} F/K/A {b} Corp", "The L.L.C. {n}", "N0rth 5ons {n} pvt. ltd.", "www.{t}.com", "{n} & {t} Company (ID: {k}) | www.x.com", "{n} {n} d.b.a. {t} incorporated", "",
    "L L C", "{t} a b c formerly known as {n}, Limited", "a1b c4t {n} {k}", "https://x-{k}.org/a b",
)
ADDRESSES = (
    "0{k} Main St, TX, 00272", "2nd Floor, 12 {n} St", "{k} n main rd,, Maharashtra, 400001", "P.O. Box {k}, 3rd Ave", "po box {k}, 5 opp park, CA, 90210", "0083-{k} nr {t}, tn", "null, n/a, 7 r {n} {n}, 075001",
    "", "door no 5, sector 9, New Delhi, 110001", "12/4 st, washington, wa", "west virginia, 000 {b} hwy 0{k}", "5 st. ct. {k} , 01234 ,",
)
COUNTRIES = ("us", "india", "france")
_FIELDS = {"{n}": "p_name", "{t}": "p_type", "{b}": "p_brand", "{k}": "p_partkey"}


def _filled(patterns):  # noqa: ANN001, ANN202
    """The pattern that a part's key picks, with the part's words in it."""
    out = F.lit(None).cast("string")
    for i, pattern in enumerate(patterns):
        text = F.lit(pattern)
        for mark, col in _FIELDS.items():
            text = F.replace(text, F.lit(mark), F.col(col).cast("string"))
        out = F.when(F.col("p_partkey") % len(patterns) == i, text).otherwise(out)
    return out


def _filled_sql(patterns):  # noqa: ANN001, ANN202
    fields = lambda p: "replace(replace(replace(replace('{}', '{{n}}', p_name), '{{t}}', p_type), '{{b}}', p_brand), '{{k}}', p_partkey::VARCHAR)".format(p)
    return f"CASE p_partkey % {len(patterns)} " + " ".join(f"WHEN {i} THEN {fields(p)}" for i, p in enumerate(patterns)) + " END"


def _parts(spark, sf):  # noqa: ANN001, ANN202
    country = F.element_at(F.array(*[F.lit(c) for c in COUNTRIES]), (F.col("p_partkey") % len(COUNTRIES) + 1).cast("int"))
    return t(spark, sf, "part").select(F.col("p_partkey").alias("id"), _filled(NAMES).alias("name"), _filled(ADDRESSES).alias("addr"), country.alias("country"))


def _words(spark, sf):  # noqa: ANN001, ANN202
    """The words of each whole document, lower-cased letters and digits only."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    return t(spark, sf, "documents").select("doc_id", F.explode(F.array(words)).alias("w"))


def leet_fix(spark, sf):  # noqa: ANN001, ANN201
    mixed = F.transform("w", lambda x, i: F.when(i % 2 == 0, F.translate(x, "oea", "034")).otherwise(x))
    return _words(spark, sf).select("doc_id", joined(fix_leet(mixed)).alias("fixed"))


def collapse_initials_q(spark, sf):  # noqa: ANN001, ANN201
    single = F.transform("w", lambda x, i: F.when(i % 4 < 2, F.substring(x, 1, 1)).otherwise(x))
    return _words(spark, sf).select("doc_id", joined(collapse_initials(single)).alias("collapsed"))


def dedupe_consecutive_q(spark, sf):  # noqa: ANN001, ANN201
    return _words(spark, sf).select("doc_id", joined(dedupe_consecutive(F.transform("w", lambda x: F.substring(x, 1, 1)))).alias("deduped"))


def array_set_ops(spark, sf):  # noqa: ANN001, ANN201
    """Set operations between the first half of a document's words and the rest."""
    half = F.floor(F.size("w") / 2).cast("int")
    w = _words(spark, sf).select("doc_id", F.slice("w", F.lit(1), half).alias("a"), F.slice("w", half + 1, F.size("w")).alias("b"))
    s = lambda c: F.array_join(F.array_sort(c), " ")
    return w.select("doc_id", s(F.array_intersect("a", "b")).alias("both"), s(F.array_except("a", "b")).alias("only_a"), s(F.array_union("a", "b")).alias("either"))


def phonetic_skeleton_a(spark, sf):  # noqa: ANN001, ANN201
    return _words(spark, sf).select("doc_id", line_a.phonetic(joined(F.col("w"))).alias("phonetic"))


def phonetic_skeleton_b(spark, sf):  # noqa: ANN001, ANN201
    return _words(spark, sf).select("doc_id", line_b.consonants(joined(F.col("w"))).alias("skeleton"))


def noise_markers(spark, sf):  # noqa: ANN001, ANN201
    """Markers of whole texts, read both as name and as address."""
    d = t(spark, sf, "documents").select("doc_id", F.col("text").alias("name"), F.col("text").alias("addr"))
    return d.select("doc_id", *[c.alias(k) for k, c in line_b.noise_markers(F.col("name"), F.col("addr")).items()])


def clean_domain(spark, sf):  # noqa: ANN001, ANN201
    stem, flag = line_a.domain_stem(F.lower("url"))
    return t(spark, sf, "pages").select("page_id", stem.alias("stem"), flag.alias("is_domain"), joined(line_b.name_words(F.col("url"))).alias("name_b"))


def url_tail_strip(spark, sf):  # noqa: ANN001, ANN201
    p = t(spark, sf, "pages").select("page_id", F.concat(F.lit("Shop "), F.col("page_id").cast("string"), F.lit(" (ID: "), F.col("page_id").cast("string"), F.lit(") | "), F.col("url")).alias("raw"))
    return p.select("page_id", F.trim(line_a.strip_tags(F.col("raw"))).alias("stripped"))


def name_clean_a(spark, sf):  # noqa: ANN001, ANN201
    ship(spark)
    return line_a.clean_name(_parts(spark, sf), "name").select("id", "name_clean", "name_core", "name_alt", "legal", "name_nonlatin", "name_is_domain")


def clean_address(spark, sf):  # noqa: ANN001, ANN201
    ship(spark)
    return line_a.clean_address(_parts(spark, sf), "addr", "country").select("id", "addr_clean", "addr_nums", "state", "postcode")


def normalize_b(spark, sf):  # noqa: ANN001, ANN201
    ship(spark)
    return line_b.prepared(_parts(spark, sf)).select("id", "name_n", "core_n", "skel", "addr_n", "addr_c", "core_c", "legal")


def legal_set(spark, sf):  # noqa: ANN001, ANN201
    """Legal forms of part types read as names: the last word becomes a legal word by the key."""
    forms = F.array(*[F.lit(w) for w in ("incorporated", "company", "ltd", "private limited", "cie")])
    p = t(spark, sf, "part").select("p_partkey", F.concat_ws(" ", F.lower("p_name"), F.get(forms, (F.col("p_partkey") % 5).cast("int"))).alias("n"))
    return p.select("p_partkey", joined(line_b.legal_words(tokens(F.col("n")))).alias("legal"), joined(line_a.legal_of(tokens(F.col("n")))).alias("legal_a"))


def translit_docs(spark, sf):  # noqa: ANN001, ANN201
    ship(spark)
    return t(spark, sf, "documents").select("doc_id", translit.ascii_text(F.col("text")).alias("plain"))


def profile_columns(spark, sf):  # noqa: ANN001, ANN201
    from linkloom.sources.tables import profile

    out = profile(t(spark, sf, "documents"))
    return out.select("n", "column", *[F.round(c, 6).alias(c) for c in ("null_share", "empty_share", "mean_length")])


QUERIES = {
    "leet_fix": leet_fix, "collapse_initials": collapse_initials_q, "dedupe_consecutive": dedupe_consecutive_q, "array_set_ops": array_set_ops,
    "phonetic_skeleton_a": phonetic_skeleton_a, "phonetic_skeleton_b": phonetic_skeleton_b, "noise_markers": noise_markers, "clean_domain": clean_domain,
    "url_tail_strip": url_tail_strip, "alias_split_legal_core": name_clean_a, "clean_address": clean_address, "normalize_b": normalize_b,
    "legal_set": legal_set, "translit_docs": translit_docs, "profile_columns": profile_columns,
}

_W = "w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)"
_SPACES = "trim(regexp_replace({}, '\\s+', ' ', 'g'))"
# A token at even places is written with digits for letters, as in the query.
_SKEL = "array_to_string(w, ' ')"
for _a, _b in (("0", "o"), ("1", "l"), ("3", "e"), ("4", "a"), ("5", "s"), ("6", "g"), ("8", "b")):
    _SKEL = f"regexp_replace({_SKEL}, '([a-z]){_a}|{_a}([a-z])', '\\1{_b}\\2', 'g')"
for _a, _b in (("ph", "f"), ("bh", "b"), ("dh", "d"), ("th", "t"), ("kh", "k"), ("gh", "g"), ("sh", "s"), ("ch", "c"), ("ck", "k"), ("q", "k"), ("x", "ks"), ("z", "s"), ("c", "k"), ("w", "v"), ("v", "b")):
    _SKEL = f"replace({_SKEL}, '{_a}', '{_b}')"
_SKEL = f"regexp_replace({_SKEL}, '[aeiouyh]', '', 'g')"
for _c in "bdfgjklmnprstv":
    _SKEL = f"regexp_replace({_SKEL}, '{_c}{_c}+', '{_c}', 'g')"

_PHON = "x"
for _a, _b in V.PHONETIC_PAIRS_A:
    _PHON = f"replace({_PHON}, '{_a}', '{_b}')"
_PHON = f"translate(regexp_replace(regexp_replace({_PHON}, 'c([eiy])', 's\\1', 'g'), 'g([eiy])', 'j\\1', 'g'), 'cqxzwydm', 'kkksvitn')"
_PHON = f"list_transform([{_PHON}], lambda v: substr(v, 1, 1) || regexp_replace(substr(v, 2), '[aeiou]+', '', 'g'))[1]"
for _c in "abcdefghijklmnopqrstuvwxyz":
    _PHON = f"regexp_replace({_PHON}, '{_c}{_c}+', '{_c}', 'g')"



def _case(x: str, mapping) -> str:  # noqa: ANN001
    return f"CASE {x} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in mapping.items()) + f" ELSE {x} END"


def _among(x: str, words) -> str:  # noqa: ANN001
    return f"{x} IN ({', '.join(repr(w) for w in words)})"


def _token_sql(source: str) -> str:
    """CTEs up to ``tk (id, part, w)``: the name tokens of texts (id, part, x). Single letters carry a mark until their runs are joined."""
    return f"""k1 AS (SELECT id, part, list_filter(string_split(regexp_replace(replace(replace(x, '&', ' and '), '+', ' plus '), '[^a-z0-9 ]+', ' ', 'g'), ' '), lambda v: v <> '') AS w FROM {source}),
k2 AS (SELECT id, part, list_transform(w, lambda v: CASE WHEN regexp_matches(v, '[0-9]') AND length(regexp_replace(v, '[^a-z]', '', 'g')) >= 2 THEN translate(v, '0134578', 'oleastb') ELSE v END) AS w FROM k1),
k3 AS (SELECT id, part, list_reduce(list_concat([['']], list_transform(w, lambda v: [CASE WHEN regexp_matches(v, '^[a-z]$') THEN v || '#' ELSE v END])),
 lambda acc, e: CASE WHEN suffix(acc[-1], '#') AND suffix(e[1], '#') THEN list_append(acc[1 : len(acc) - 1], acc[-1][1 : length(acc[-1]) - 1] || e[1]) ELSE list_append(acc, e[1]) END) AS w FROM k2),
k4 AS (SELECT id, part, list_filter(list_transform(w, lambda v: replace(v, '#', '')), lambda v: v <> '') AS w FROM k3), tk AS (SELECT id, part, list_filter(w, lambda v, i: i = 1 OR v <> w[i - 1]) AS w FROM k4)"""


_ALIAS_SQL = line_a.ALIAS
_CORE = "array_to_string(list_filter({}, lambda v: NOT " + _among("v", [*V.LEGAL_A, *V.NAME_STOP_A]) + "), ' ')"
_STATES = sorted({*V.US_STATES_A, *V.US_STATES_A.values(), *V.IN_STATES_A, *V.IN_STATES_A.values(), *V.MORE_STATES_A})
_BARE = "CASE WHEN ltrim({0}, '0') = '' THEN '0' ELSE ltrim({0}, '0') END"



def _rewritten(x: str, rules) -> str:  # noqa: ANN001
    for found, put in rules:
        x = f"regexp_replace({x}, '{found.replace(chr(39), chr(39) * 2)}', '{put.replace('$', chr(92))}', 'g')"
    return x


def _address_sql(x: str) -> str:
    """Address words of lower-cased text; state names between spaces are marked, then read as codes."""
    plain = f"trim(regexp_replace({_rewritten(x, line_b.ADDRESS_RULES)}, '\\s+', ' ', 'g'))"
    marked = f"regexp_replace(' ' || {plain} || ' ', ' ({'|'.join(V.STATES_B)}) ', ' ' || chr(1) || '\\1' || chr(1) || ' ', 'g')"
    codes = f"array_to_string(list_transform(string_split({marked}, chr(1)), lambda v: {_case('v', V.STATES_B)}), '')"
    return f"list_transform(list_filter(string_split(regexp_replace({codes}, '\\s+', ' ', 'g'), ' '), lambda v: v <> ''), lambda v: {_case('v', V.ADDR_ABBR_B)})"


_PICKED = "CASE WHEN len({0}) > 0 THEN {0} ELSE {1} END"

ORACLES = {
    "normalize_b": f"""WITH raw AS (SELECT p_partkey AS id, lower({_filled_sql(NAMES)}) AS name, lower({_filled_sql(ADDRESSES)}) AS addr FROM part),
w AS (SELECT id, list_filter(string_split({_rewritten('name', line_b.NAME_RULES)}, ' '), lambda v: v <> '') AS n, {_address_sql('addr')} AS a, {_address_sql(_rewritten('addr', line_b.CONTACT_RULES))} AS c FROM raw),
x AS (SELECT *, list_filter(n, lambda v: NOT {_among('v', V.LEGAL_WORDS_B)}) AS core0 FROM w), y AS (SELECT *, {_PICKED.format('core0', 'n')} AS w FROM x),
z AS (SELECT *, w AS core, list_filter(w, lambda v: NOT {_among('v', V.FILLER_B)} AND NOT regexp_matches(v, '{line_b.LONG_NUMBER}')) AS telling FROM y)
SELECT id, array_to_string(n, ' ') AS name_n, array_to_string(core, ' ') AS core_n, {_SPACES.format(_SKEL)} AS skel, array_to_string(a, ' ') AS addr_n,
array_to_string(list_filter(c, lambda v: NOT {_among('v', V.ADDR_JUNK_B)}), ' ') AS addr_c, array_to_string({_PICKED.format('telling', 'core')}, ' ') AS core_c,
array_to_string(list_sort(list_distinct(list_transform(list_filter(n, lambda v: {_among('v', V.LEGAL_FORMS_B)}), lambda v: {_case('v', V.LEGAL_FORMS_B)}))), ' ') AS legal FROM z""",
    "alias_split_legal_core": f"""WITH raw AS (SELECT p_partkey AS id, {_filled_sql(NAMES)} AS name FROM part),
s AS (SELECT id, trim(lower(regexp_replace(regexp_replace(name, '\\(\\s*id\\s*:?\\s*\\d+\\s*\\)', ' ', 'gi'), '\\|\\s*(?:https?://)?(?:www\\.)?\\S+\\s*$', ' ', 'gi'))) AS s FROM raw),
d AS (SELECT id, s, regexp_extract(s, '{line_a.DOMAIN}', 1) AS stem FROM s), e AS (SELECT id, (stem <> '' AND NOT contains(s, ' ')) AS hit, CASE WHEN stem <> '' AND NOT contains(s, ' ') THEN replace(stem, '-', ' ') ELSE s END AS d FROM d),
p AS (SELECT id, hit, regexp_split_to_array(d, '{_ALIAS_SQL}') AS parts FROM e),
texts AS (SELECT id, 'all' AS part, array_to_string(parts, ' ') AS x FROM p UNION ALL SELECT id, 'first', parts[1] FROM p UNION ALL SELECT id, 'last', parts[-1] FROM p), {_token_sql('texts')},
m AS (SELECT p.id, hit, len(parts) > 1 AS alias, list_transform(a.w, lambda v: {_case('v', V.LEGAL_A)}) AS t, {_CORE.format('f.w')} AS first, {_CORE.format('l.w')} AS last FROM p
 JOIN tk a ON a.id = p.id AND a.part = 'all' JOIN tk f ON f.id = p.id AND f.part = 'first' JOIN tk l ON l.id = p.id AND l.part = 'last')
SELECT id, array_to_string(t, ' ') AS name_clean, CASE WHEN alias AND last <> '' THEN last ELSE {_CORE.format('t')} END AS name_core, CASE WHEN alias THEN first ELSE '' END AS name_alt,
array_to_string(list_sort(list_distinct(list_filter(string_split(array_to_string(list_transform(list_filter(t, lambda v: {_among('v', V.LEGAL_A)}), lambda v: {_case('v', V.LEGAL_A)}), ' '), ' '), lambda v: v <> ''))), ' ') AS legal, 0 AS name_nonlatin, hit::INT AS name_is_domain FROM m""",
    "clean_address": f"""WITH raw AS (SELECT p_partkey AS id, lower({_filled_sql(ADDRESSES)}) AS addr, {list(COUNTRIES)}[p_partkey % {len(COUNTRIES)} + 1] AS country FROM part),
c0 AS (SELECT id, country, list_transform(string_split(addr, ','), lambda c: {{'raw': c, 'c': array_to_string(list_filter(string_split(regexp_replace(c, '[^a-z0-9 ]+|\\s+', ' ', 'g'), ' '), lambda v: v <> ''), ' ')}}) AS cs FROM raw),
c1 AS (SELECT id, country, list_filter(cs, lambda c: c.c <> '') AS cs FROM c0), c2 AS (SELECT id, country, cs, coalesce(list_position(list_transform(cs, lambda c: {_among('c.c', _STATES)}), true), 0) AS hit FROM c1),
c3 AS (SELECT id, CASE WHEN hit = 0 THEN '' WHEN country = 'us' THEN {_case('cs[hit].c', V.US_STATES_A)} WHEN country = 'india' THEN {_case('cs[hit].c', V.IN_STATES_A)} ELSE cs[hit].c END AS state,
 regexp_replace(array_to_string(list_transform(list_filter(cs, lambda c, i: i <> hit), lambda c: c.raw), ' , '), '{line_a.PO_BOX}', ' ', 'g') AS rest FROM c2),
c4 AS (SELECT id, state, regexp_extract(rest, '{line_a.POSTCODE}', 1) AS code, list_filter(string_split(regexp_replace(rest, '[^a-z0-9 ]+|\\s+', ' ', 'g'), ' '), lambda v: v <> '') AS w FROM c3),
c5 AS (SELECT id, state, code, list_filter(list_transform(w, lambda v: CASE WHEN regexp_matches(v, '^[0-9]+$') THEN {_BARE.format('v')} ELSE regexp_replace({_case('v', V.ADDR_ABBR_A)}, '^([0-9]+)(?:st|nd|rd|th)$', '\\1') END), lambda v: NOT {_among('v', V.ADDR_STOP_A)}) AS w FROM c4),
c6 AS (SELECT id, state, code, list_filter(w, lambda v, i: i = 1 OR v <> w[i - 1]) AS w FROM c5)
SELECT id, array_to_string(w, ' ') AS addr_clean, array_to_string(list_filter(w, lambda v: regexp_matches(v, '[0-9]')), ' ') AS addr_nums, state, CASE WHEN code = '' THEN '' ELSE {_BARE.format('code')} END AS postcode FROM c6""",
    "phonetic_skeleton_a": f"WITH {_W} SELECT doc_id, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') THEN x ELSE {_PHON} END), ' ') AS phonetic FROM w",
    "leet_fix": f"WITH {_W}, m AS (SELECT doc_id, list_transform(w, lambda x, i: CASE WHEN i % 2 = 1 THEN translate(x, 'oea', '034') ELSE x END) AS w FROM w) SELECT doc_id, array_to_string(list_transform(w, lambda x: CASE WHEN regexp_matches(x, '[0-9]') AND length(regexp_replace(x, '[^a-z]', '', 'g')) >= 2 THEN translate(x, '0134578', 'oleastb') ELSE x END), ' ') AS fixed FROM m",
    "collapse_initials": f"""WITH {_W}, m AS (SELECT doc_id, list_transform(w, lambda x, i: CASE WHEN (i - 1) % 4 < 2 THEN substr(x, 1, 1) ELSE x END) AS w FROM w),
e AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM m), f AS (SELECT *, regexp_matches(x, '^[a-z]$') AND coalesce(regexp_matches(lag(x) OVER (PARTITION BY doc_id ORDER BY i), '^[a-z]$'), false) AS glue FROM e),
g AS (SELECT doc_id, i, (CASE WHEN glue OR i = 1 THEN '' ELSE ' ' END) || x AS x FROM f)
SELECT d.doc_id, coalesce(string_agg(g.x, '' ORDER BY g.i), '') AS collapsed FROM documents d LEFT JOIN g USING (doc_id) GROUP BY d.doc_id""",
    "dedupe_consecutive": f"WITH {_W}, m AS (SELECT doc_id, list_transform(w, lambda x: substr(x, 1, 1)) AS w FROM w) SELECT doc_id, array_to_string(list_filter(w, lambda x, i: i = 1 OR x <> w[i - 1]), ' ') AS deduped FROM m",
    "array_set_ops": f"WITH {_W}, m AS (SELECT doc_id, w[1 : len(w) // 2] AS a, w[len(w) // 2 + 1 :] AS b FROM w) SELECT doc_id, array_to_string(list_sort(list_distinct(list_intersect(a, b))), ' ') AS both, array_to_string(list_sort(list_distinct(list_filter(a, lambda x: NOT list_contains(b, x)))), ' ') AS only_a, array_to_string(list_sort(list_distinct(a || b)), ' ') AS either FROM m",
    "phonetic_skeleton_b": f"WITH {_W} SELECT doc_id, {_SPACES.format(_SKEL)} AS skeleton FROM w",
    "noise_markers": """WITH d AS (SELECT doc_id, text AS name, text AS addr FROM documents), k AS (SELECT *, regexp_extract_all(lower(name), '[a-z]+') AS tk FROM d)
SELECT doc_id, (len(tk) > len(list_distinct(tk)))::INT::DOUBLE AS mk_dup, regexp_matches(name, '[À-ÿ]')::INT::DOUBLE AS mk_accent, regexp_matches(name, '[A-Za-z][0-9][A-Za-z]')::INT::DOUBLE AS mk_ocr, regexp_matches(name, '^[^\\p{L}\\p{M}\\p{N}_]')::INT::DOUBLE AS mk_junk,
regexp_matches(name, '[\\[(]')::INT::DOUBLE AS mk_brackets, regexp_matches(name, '[ऀ-෿]')::INT::DOUBLE AS mk_script, regexp_matches(name, '\\.com|www|\\.in\\b|\\.net')::INT::DOUBLE AS mk_domain, (name = upper(name))::INT::DOUBLE AS mk_upper_name,
regexp_matches(addr, '\\b0+[1-9][0-9]*')::INT::DOUBLE AS mk_zeropad, regexp_matches(addr, '##|#[0-9]')::INT::DOUBLE AS mk_hash, regexp_matches(lower(addr), 'po box|pmb')::INT::DOUBLE AS mk_pobox, (addr = upper(addr) AND addr <> '')::INT::DOUBLE AS mk_upper_addr FROM k""",
    "clean_domain": f"""WITH d AS (SELECT page_id, lower(url) AS u, regexp_extract(lower(url), '^(?:https?://)?(?:www\\.)?([a-z0-9\\-]+)\\.(?:com|net|org|in|co\\.in|co|fr|io|biz|us|info)\\b', 1) AS s, url FROM pages)
SELECT page_id, CASE WHEN s <> '' AND NOT contains(u, ' ') THEN replace(s, '-', ' ') ELSE u END AS stem, (s <> '' AND NOT contains(u, ' '))::INT AS is_domain,
{_SPACES.format("regexp_replace(regexp_replace(replace(regexp_replace(regexp_replace(u, '(https?://)?(www\\.)?([a-z0-9\\-]+)\\.(com|net|org|co\\.in|in|co|fr|biz|info|us)\\b', ' \\3 ', 'g'), '#\\s*[0-9]+', ' ', 'g'), '&', ' and '), '[''.]', '', 'g'), '[^a-z0-9]+', ' ', 'g')")} AS name_b FROM d""",
    "url_tail_strip": "SELECT page_id, trim(regexp_replace(regexp_replace('Shop ' || page_id || ' (ID: ' || page_id || ') | ' || url, '\\(\\s*id\\s*:?\\s*\\d+\\s*\\)', ' ', 'gi'), '\\|\\s*(?:https?://)?(?:www\\.)?\\S+\\s*$', ' ', 'gi')) AS stripped FROM pages",
    "legal_set": """WITH p AS (SELECT p_partkey, lower(p_name) || ' ' || ['incorporated', 'company', 'ltd', 'private limited', 'cie'][p_partkey % 5 + 1] AS n FROM part),
b AS (SELECT * FROM (VALUES ('inc','inc'),('incorporated','inc'),('corp','corp'),('corporation','corp'),('co','co'),('company','co'),('ltd','ltd'),('limited','ltd'),('pvt','pvt'),('private','pvt'),('cie','co')) v(w, f)),
x AS (SELECT p_partkey, f, w FROM (SELECT p_partkey, unnest(string_split(n, ' ')) AS w FROM p) JOIN b USING (w))
SELECT p_partkey, coalesce(string_agg(DISTINCT f, ' ' ORDER BY f), '') AS legal, coalesce(string_agg(DISTINCT CASE WHEN w <> 'cie' THEN f END, ' ' ORDER BY CASE WHEN w <> 'cie' THEN f END), '') AS legal_a FROM x GROUP BY p_partkey""",
    "profile_columns": " UNION ALL ".join(
        f"SELECT count(*) AS n, '{c}' AS \"column\", round(avg(({c} IS NULL)::INT), 6) AS null_share, round(avg((coalesce({c}::VARCHAR, '') = '')::INT), 6) AS empty_share, round(avg(length({c}::VARCHAR)), 6) AS mean_length FROM documents"
        for c in ("doc_id", "text", "lang", "source", "n_chars")
    ),
}

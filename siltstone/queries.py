"""The registered queries over the standard tables, each with its SQL where SQL can say the same.

Roles: ``documents`` are text files (project = source, ingest source = lang), ``pages`` HTML files,
``conversations`` chats, ``events`` requests and log lines, ``orders`` runs, the other tables tabular files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone import registry as R
from siltstone.functions import fingerprint, paths, redact, shards
from siltstone.functions import text as T
from siltstone.operators import config, csvprof, documents, findings, neardup
from siltstone.plans import notebook, store
from siltstone.sources import files as S
from siltstone.sources import logs, packed
from siltstone.streaming import limits

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
W = r"[\p{L}\p{N}_]+"


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def q(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("'", "''") + "'"


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def joined(array):
    return F.array_join(array, "|")


TOK = f"regexp_extract_all(lower(text), {q(W)})"


def text():
    """The column; made when a query is built, as a session is there then."""
    return F.col("text")


# --- words and fingerprints ---


@query(f"select doc_id, len({TOK})::BIGINT n_tokens, len(list_distinct({TOK}))::BIGINT n_distinct from documents")
def tokens_per_doc(spark, d):
    words = T.tokens(text())
    return t(spark, d, "documents").select("doc_id", F.size(words).cast("bigint").alias("n_tokens"), F.size(F.array_distinct(words)).cast("bigint").alias("n_distinct"))


@query(f"select token, count(*)::BIGINT n from (select unnest({TOK}) token from documents) group by 1 order by n desc, token limit 50")
def token_freq_topk(spark, d):
    words = t(spark, d, "documents").select(F.explode(T.tokens(text())).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "token").limit(50)


@query("select doc_id, sha256(text) source_hash, octet_length(encode(text))::BIGINT n_bytes from documents")
def source_hash(spark, d):
    return t(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("source_hash"), F.octet_length("text").cast("bigint").alias("n_bytes"))


@query(
    "select doc_id, h content_hash, (min(doc_id) over (partition by h))::BIGINT class_id, (count(*) over (partition by h))::BIGINT copies from (select doc_id, sha256(coalesce(text,'')) h from documents)"
)
def exact_duplicates(spark, d):
    return neardup.exact_classes(t(spark, d, "documents"), "doc_id", "text")


_SIM = f"""t as (select doc_id, unnest({TOK}) w from documents),
c as (select doc_id, w, count(*) n from t group by 1,2), h as (select doc_id, n, md5(w) m from c),
b as (select doc_id, n, m, unnest(range(64)) i from h),
v as (select doc_id, i, sum(case when (('0x'||substr(m,2*(i//8)+1,2))::INT >> (i%8)::INT) & 1 = 1 then n else -n end) s from b group by 1,2),
f as (select doc_id, sum(case when s>0 then (1::HUGEINT << i::INT) else 0 end)::UBIGINT x from v group by 1),
p as (select d.doc_id, coalesce(f.x, 0::UBIGINT) x from documents d left join f using (doc_id) where d.text is not null)"""


@query(f"with {_SIM} select doc_id, printf('%016x', x) simhash from p")
def simhash64(spark, d):
    return t(spark, d, "documents").where("text is not null").select("doc_id", fingerprint.simhash_hex("text").alias("simhash"))


@query(f"with {_SIM}, k as (select x, min(doc_id) id from p group by 1) select a.id::BIGINT a, b.id::BIGINT b, bit_count(xor(a.x, b.x))::BIGINT distance from k a, k b where a.id < b.id and bit_count(xor(a.x, b.x)) <= 3")
def near_dup_pairs_simhash(spark, d):
    return neardup.simhash_pairs(simhash64(spark, d), "doc_id", "simhash")


_MIN = f"""t as (select doc_id, {TOK} a from documents where text is not null),
s as (select distinct doc_id, unnest(case when len(a)>=3 then list_transform(range(1,len(a)-1), lambda i: a[i]||' '||a[i+1]||' '||a[i+2]) else a end) g from t),
m as (select doc_id, p, min(substr(sha256(p||':'||g),1,8)) v from s, range(32) r(p) group by 1,2),
l as (select doc_id, list(v order by p) vs from m group by 1),
z as (select t.doc_id, coalesce(vs, list_transform(range(32), lambda i: '0')) vs from t left join l using (doc_id))"""


@query(f"with {_MIN} select doc_id, array_to_string(vs, ',') minhash from z")
def minhash_32(spark, d):
    docs = t(spark, d, "documents").where("text is not null")
    return docs.select("doc_id", fingerprint.minhash(text(), 32).alias("m")).select("doc_id", fingerprint.minhash_text(F.col("m")).alias("minhash"))


@query(
    f"with {_MIN}, k as (select vs, min(doc_id) id from z group by 1), j as (select a.id a, b.id b, len(list_filter(range(1,33), lambda i: a.vs[i]=b.vs[i]))/32.0 s from k a, k b where a.id < b.id) "
    "select a::BIGINT a, b::BIGINT b, round(s::DOUBLE, 6) similarity from j where s >= 0.8"
)
def jaccard_pairs_minhash(spark, d):
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", fingerprint.minhash(text(), 32).alias("slots"))
    return neardup.jaccard_pairs(docs, "doc_id", "slots").withColumn("similarity", F.round("similarity", 6))


# --- measures ---


@query(
    """with h as (select doc_id, hex(encode(text)) h from documents), b as (select doc_id, substr(h, 2*i+1, 2) c from (select doc_id, h, unnest(range(len(h)//2)) i from h)),
n as (select doc_id, c, count(*) n from b group by 1,2), s as (select doc_id, sum(n) t, sum(n*log2(n)) l from n group by 1)
select d.doc_id, round(coalesce(log2(t) - l/t, 0.0), 6) entropy from documents d left join s using (doc_id)"""
)
def byte_entropy(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(T.byte_entropy("text"), 6).alias("entropy"))


@query(
    """with b as (select doc_id, unnest(string_split(text, '')) c from documents), n as (select doc_id, c, count(*) n from b where c <> '' group by 1,2),
s as (select doc_id, sum(n) t, sum(n*log2(n)) l, count(*) k from n group by 1)
select d.doc_id, round(case when k > 1 then (log2(t) - l/t) / log2(least(k, 256)) else 0.0 end, 6) entropy from documents d left join s using (doc_id)"""
)
def char_entropy_norm(spark, d):
    return t(spark, d, "documents").select("doc_id", F.round(T.char_entropy("text"), 6).alias("entropy"))


def _sh(pattern: str) -> str:
    return f"(length(regexp_replace(text, {q(pattern)}, '', 'g')) / octet_length(encode(text)))"


@query(
    f"select doc_id, octet_length(encode(text))::BIGINT n_bytes, round(octet_length(encode(text)) / greatest(length(text) - length(replace(text, chr(10), '')), 1), 6) avg_line_length, "
    f"round({_sh('[^ ' + chr(10) + chr(9) + ']')}, 6) whitespace_ratio from documents"
)
def complexity_metrics(spark, d):
    n = F.octet_length("text")
    breaks = F.length("text") - F.length(F.replace(text(), F.lit("\n"), F.lit("")))
    return t(spark, d, "documents").select("doc_id", n.cast("bigint").alias("n_bytes"), F.round(n / F.greatest(breaks, F.lit(1)), 6).alias("avg_line_length"), F.round(T.share(text(), "[^ \n\t]"), 6).alias("whitespace_ratio"))


@query()
def complexity_route(spark, d):
    c = T.complexity(text())
    return t(spark, d, "documents").select("doc_id", *[x.alias(k) for k, x in c.items()])


@query(f"select doc_id, round({_sh('[^A-Za-z]')}, 6) alpha, round({_sh('[^0-9]')}, 6) digit, round({_sh('[^ ' + chr(10) + chr(9) + ']')}, 6) space from documents")
def content_weights(spark, d):
    w = T.content_weights(text())
    return t(spark, d, "documents").select("doc_id", *[F.round(w[k], 6).alias(k) for k in ("alpha", "digit", "space")])


@query()
def content_type_sniff(spark, d):
    return t(spark, d, "documents").select("doc_id", T.content_type(text()).alias("content_type"))


@query(
    "select source, lang, tag, count(*)::BIGINT n_files, sum(b)::BIGINT n_bytes from (select source, lang, octet_length(encode(text)) b, case when octet_length(encode(text)) >= 10000000 then 'rejected' "
    "when octet_length(encode(text)) >= 5000000 then 'potential_god' when octet_length(encode(text)) >= 500000 then 'large' else 'normal' end tag from documents) group by 1,2,3"
)
def size_tag_hist(spark, d):
    docs = t(spark, d, "documents").select("source", "lang", T.size_tag(F.lit("doc"), text()).alias("tag"), F.octet_length("text").alias("b"))
    return docs.groupBy("source", "lang", "tag").agg(F.count(F.lit(1)).alias("n_files"), F.sum("b").cast("bigint").alias("n_bytes"))


@query(f"select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, {q(r'\S')})))::BIGINT loc from documents")
def lines_of_code(spark, d):
    return t(spark, d, "documents").select("doc_id", T.lines_of_code(text()).cast("bigint").alias("loc"))


# --- redaction and safety ---


def _chain(column: str, patterns, label: str) -> str:
    for name, p in patterns:
        column = f"regexp_replace({column}, {q(p)}, '[{label}:{name}]', 'g')"
    return column


_RED = f"(case when length(text) >= 8 then {_chain('text', redact.SECRETS, 'REDACTED')} else text end)"


@query(f"select doc_id, sha256({_RED}) redacted_hash, ({_RED} <> text) changed from documents where text is not null")
def secret_redact(spark, d):
    docs = t(spark, d, "documents").where("text is not null").select("doc_id", "text", redact.redact_secrets(text()).alias("r"))
    return docs.select("doc_id", F.sha2("r", 256).alias("redacted_hash"), (F.col("r") != text()).alias("changed"))


def _kinds_sql() -> str:
    out, column = [], "text"
    for name, p in redact.SECRETS:
        out.append(f"select {q(name)} kind, count(*)::BIGINT n from documents where length(text) >= 8 and regexp_matches({column}, {q(p)})")
        column = f"regexp_replace({column}, {q(p)}, '[REDACTED:{name}]', 'g')"
    return f"select * from ({' union all '.join(out)}) where n > 0"


@query(_kinds_sql())
def secret_scan_counts(spark, d):
    docs = t(spark, d, "documents").where(redact.has_secret(text()))
    return docs.select(F.explode(redact.secret_kinds(text())).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


#: The one pattern with lookahead, which the engine of the SQL lacks, for counting.
_DAN = r"(?i)\bDAN\b\s*(mode|prompt|jailbreak|enabled|activated|is|:)"
_INJ = tuple((n, _DAN if n == "dan_jailbreak" else p) for n, p in redact.INJECTIONS)
_CHATS = "(select text from conversations union all select text from documents union all select html from pages)"


@query("select * from (" + " union all ".join(f"select {q(n)} kind, count(*)::BIGINT n from {_CHATS} where length(text) >= 10 and regexp_matches(text, {q(p)})" for n, p in _INJ) + ") where n > 0")
def injection_scan_counts(spark, d):
    every = t(spark, d, "conversations").select("text").unionByName(t(spark, d, "documents").select("text")).unionByName(t(spark, d, "pages").select(F.col("html").alias("text")))
    return every.select(F.explode(redact.injection_kinds(text())).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


def _block_sql() -> str:
    out = "text"
    for n, p in redact.INJECTIONS:
        m = f"regexp_extract(text, {q(p)}, 0)" if n != "dan_jailbreak" else f"regexp_extract(text, {q(r'(?i)(\bDAN\b)\s*(?:mode|prompt|jailbreak|enabled|activated|is|:)')}, 1)"
        out = f"replace({out}, {m}, '[INJECTION_BLOCKED:{n}]')"
    return out


@query(f"with c as (select conv_id, turn, {_RED} as text from conversations) select conv_id, turn, (case when length(text) >= 10 then {_block_sql()} else text end) clean from c")
def injection_block(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", redact.redact_secrets(text()).alias("text")).select("conv_id", "turn", redact.block_injections(text()).alias("clean"))


def _imperative_sql() -> str:
    cases = " ".join(f"when instr(upper(text), {q(p.upper())}) > 0 then substr(text, 1, instr(upper(text), {q(p.upper())}) - 1) || '[FILTERED:IMPERATIVE]'" for p in redact.IMPERATIVES)
    return f"select conv_id, turn, case {cases} when length(text) > 5000 then substr(text, 1, 500) || '[TRUNCATED:' || length(text) || ' chars]' else text end filtered from conversations"


@query(_imperative_sql())
def imperative_filter(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", redact.filter_literal(text()).alias("filtered"))


@query(f"select doc_id, array_to_string(list_filter([{', '.join(f'case when regexp_matches(text, {q(p)}) then {q(n)} end' for n, p in redact.SUSPICIOUS)}], lambda x: x is not null), ',') flags from documents where text is not null")
def suspicious_flags(spark, d):
    return t(spark, d, "documents").where("text is not null").select("doc_id", F.array_join(redact.suspicious(text()), ",").alias("flags"))


@query()
def content_safety(spark, d):
    return t(spark, d, "documents").select("doc_id", redact.content_safety(text()).alias("s")).select("doc_id", "s.status", F.sha2("s.text", 256).alias("text_hash"))


def _dehydrate_sql() -> str:
    fill = "map([" + ", ".join(q(w) for w in T.FILLERS) + "], [" + ", ".join(f"chr({i})" for i in range(1, len(T.FILLERS) + 1)) + "])"
    p = f"case when {fill}[lower(p)] is not null then '\\0' || {fill}[lower(p)] when regexp_matches(p, {q('^' + W)}) then case when lower(p[1]) in ('a','e','i','o','u') then p[1] || translate(p[2:], 'aeiouAEIOU', '') else translate(p, 'aeiouAEIOU', '') end else regexp_replace(p, {q(r'\s+')}, ' ', 'g') end"
    p = p.replace("'\\0'", "chr(0)")
    return f"select conv_id, turn, sha256(array_to_string(list_transform(regexp_extract_all(text, {q(W + r'|[^\p{L}\p{N}_]+')}), lambda p: {p}), '')) compact_hash from conversations"


@query(_dehydrate_sql())
def dehydrate_text(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", F.sha2(T.dehydrate(text()), 256).alias("compact_hash"))


_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(len(h)//2), lambda i: ('0x'||substr(h, 2*i+1, 2))::BIGINT)), lambda a, b: (xor(a, b) * 16777619) & 4294967295)"


@query(f"with n as (select p_name s, hex(encode(p_name)) h from part group by 1), f as (select s, {_FNV} x from n) select s as name, x::BIGINT fnv, (x % 255 + 1)::INT type_id, (x % 65535 + 1)::INT field_id from f")
def fnv_ids(spark, d):
    names = t(spark, d, "part").select(F.col("p_name").alias("name")).distinct()
    return names.select("name", T.fnv1a(F.col("name")).alias("fnv"), T.type_id(F.col("name")).alias("type_id"), T.field_id(F.col("name")).alias("field_id"))


# --- documents ---

_PARTS = r"""p as (select doc_id, unnest(range(len(a))) i, a from (select doc_id, list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')) a from documents)),
n as (select doc_id, i::BIGINT ord, a[i+1] x from p where a[i+1] <> ''),
k as (select doc_id, ord, x, octet_length(encode(x)) <= 80 and not regexp_matches(x, '[.,]$') and regexp_matches(x, '^[A-Z]') head from n),
s as (select *, coalesce(last_value(case when head then x end ignore nulls) over (partition by doc_id order by ord rows between unbounded preceding and current row), '') sec from k)"""


@query(
    f"with {_PARTS} select doc_id, ord, case when head then 'section' else 'paragraph' end node_type, upper(sha1(case when head then 'section' else 'paragraph' end || '|' || x || '|' || case when head then '' else sec end)) node_hash, "
    "case when head then '' else sec end section, x as text from s"
)
def plain_text_nodes(spark, d):
    return documents.plain_nodes(t(spark, d, "documents"), "doc_id", "text", "\n")


@query(f"with {_PARTS} select doc_id, array_to_string(list(distinct x order by x), '|') topics from s where head group by 1")
def topics(spark, d):
    nodes = documents.plain_nodes(t(spark, d, "documents"), "doc_id", "text", "\n").where("node_type = 'section'")
    return nodes.groupBy("doc_id").agg(joined(F.array_sort(F.collect_set("text"))).alias("topics"))


@query(
    r"""with w as (select doc_id, list_filter(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'), lambda w: octet_length(encode(w)) > 2 and regexp_matches(w, '^[A-Z]')) a from documents where text is not null),
u as (select doc_id, list_filter(a, lambda x, i: list_position(a, x) = i)[1:20] a from w) select doc_id, array_to_string(a, '|') entities from u"""
)
def entities(spark, d):
    return t(spark, d, "documents").where("text is not null").select("doc_id", joined(documents.capital_words(text())).alias("entities"))


@query(
    """select conv_id, turn, case when rtrim(text) like '%?' then 'question' when lower(text) like '%risk%' then 'risk' when lower(text) like '%decision%' then 'decision'
when lower(text) like '%assum%' then 'assumption' when lower(text) like '%constraint%' then 'constraint' end as class from conversations"""
)
def doc_synthesis(spark, d):
    return t(spark, d, "conversations").select("conv_id", "turn", documents.synthesis_class(text()).alias("class"))


_REF = "case when r like 'http%' and (r like '%/api/%' or r like '%/v1/%' or r like '%/v2/%') then 'api_endpoint' when r like 'http%' then 'url' when contains(r, '.') and not contains(r, ' ') then 'related_file' else 'url' end"


@query(f"select page_id, r as target, count(*)::BIGINT n, {_REF} as class from (select page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) r from pages) group by 1, 2")
def reference_class(spark, d):
    links = t(spark, d, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.groupBy("page_id", "target").agg(F.count(F.lit(1)).alias("n")).withColumn("class", documents.reference_class(F.col("target")))


@query()
def html_nodes(spark, d):
    return documents.nodes(t(spark, d, "pages"), "page_id", "html", "html")


@query()
def html_doc_fields(spark, d):
    out = documents.doc_fields(html_nodes(spark, d), "page_id")
    return out.select("page_id", *[joined(F.col(c)).alias(c) if c not in ("page_id", "title") else F.col(c) for c in out.columns if c != "page_id"])


@query()
def md_nodes(spark, d):
    return documents.nodes(t(spark, d, "documents"), "doc_id", "text", "markdown")


# --- configuration ---


@query("select event_id, array_to_string(json_keys(props), '|') toplevel_keys from events where props is not null")
def json_paths(spark, d):
    f = config.config_fields("props", F.lit("json"))
    return t(spark, d, "events").where("props is not null").select("event_id", f.alias("f")).select("event_id", joined(F.col("f.toplevel_keys")).alias("toplevel_keys"))


_URLS = r"""regexp_extract_all(html, '(?:http://|https:/)[^"''\n ]*')"""


@query(f"select page_id, len({_URLS})::BIGINT n_urls, array_to_string({_URLS}, '|') urls from pages")
def config_urls(spark, d):
    return t(spark, d, "pages").select("page_id", config.urls(F.col("html")).alias("u")).select("page_id", F.size("u").cast("bigint").alias("n_urls"), joined(F.col("u")).alias("urls"))


@query("select page_id, lower(rtrim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.')) host from pages")
def page_hosts(spark, d):
    return t(spark, d, "pages").select("page_id", paths.host(F.col("url")).alias("host"))


@query()
def db_strings(spark, d):
    docs = t(spark, d, "documents").select("doc_id", config.database_strings(text()).alias("s"))
    return docs.select("doc_id", F.size("s").cast("bigint").alias("n"), joined(F.col("s")).alias("strings"))


# --- tables ---

_TABLES = {
    "customer": ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"), "part": ("p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"),
    "orders": ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"),
}


def _profile_sql(table: str) -> str:
    cells = " union all ".join(f"select '{c}' c, coalesce(trim({c}::VARCHAR, ' '), '') v from {table}" for c in _TABLES[table])
    kinds = f"case when v = '' then 'null' when regexp_matches(v, {q(csvprof.INTEGER)}) then 'integer' when regexp_matches(v, {q(csvprof.FLOAT)}) then 'float' else 'string' end"
    return (
        f"select c column_name, case when count(*) filter (k = 'string') > 0 then 'string' when count(*) filter (k = 'float') > 0 then 'float' when count(*) filter (k = 'integer') > 0 then 'integer' else 'null' end column_type, "
        f"count(*)::BIGINT row_count, (count(*) filter (k = 'null'))::BIGINT null_count, count(distinct v)::BIGINT unique_count from (select c, v, {kinds} k from ({cells})) group by 1"
    )


def _profile(name: str) -> None:
    def run(spark: SparkSession, d: str) -> DataFrame:
        return csvprof.profile(t(spark, d, name))

    run.__name__ = f"csv_profile_{name}"
    query(_profile_sql(name))(run)


for _name in _TABLES:
    _profile(_name)


@query("select * from part order by p_partkey limit 5")
def csv_sample(spark, d):
    return csvprof.first_rows(t(spark, d, "part"), ["p_partkey"])


@query("select (event_id // 10000)::BIGINT shard, min(event_id) row_start, max(event_id) row_end, count(*)::BIGINT n_rows from events group by 1")
def shard_csv(spark, d):
    return shards.csv_shards(t(spark, d, "events"), "event_id")


@query()
def shard_text(spark, d):
    return shards.shards(t(spark, d, "documents"), "doc_id", "text", "text").drop("text")


@query()
def shard_html(spark, d):
    return shards.shards(t(spark, d, "pages"), "page_id", "html", "html").drop("text")


# --- paths, names, hosts ---

_EXT = ["py", "md", "csv", "json", "exe", "html", "tsx", "toml", "jsonl", ""]
_PATHS = f"(select doc_id, source || '/' || lang || '/doc_' || doc_id || case when {q('|'.join(_EXT))} <> '' and ([{', '.join(q(e) for e in _EXT)}])[doc_id % 10 + 1] <> '' then '.' || ([{', '.join(q(e) for e in _EXT)}])[doc_id % 10 + 1] else '' end path from documents)"


def _paths(spark, d):
    ext = F.element_at(F.array(*map(F.lit, _EXT)), (F.col("doc_id") % 10 + 1).cast("int"))
    return t(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), "doc_id", F.when(ext != "", F.concat(F.lit("."), ext)).otherwise("")).alias("path"))


@query(
    f"with p as (select doc_id, path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) e from {_PATHS}), k as (select *, case when e in ({', '.join(map(q, paths.CODE))}) then 'code' when e in ({', '.join(map(q, paths.DOC))}) then 'doc' "
    f"when e in ({', '.join(map(q, paths.CSV))}) then 'csv' when e in ({', '.join(map(q, paths.CONFIG))}) then 'config' end f from p) "
    "select doc_id, path, f field_type, case when f = 'code' then 'tree_sitter|semgrep' when f is not null then 'nim_parser' else '' end parsers from k"
)
def route_files(spark, d):
    p = F.col("path")
    return _paths(spark, d).select("doc_id", "path", paths.field_type(p).alias("field_type"), joined(paths.parsers(p)).alias("parsers"))


@query(
    f"with p as (select lower(regexp_extract(path, '\\.([^./]+)$', 1)) e from {_PATHS}), k as (select case when e in ('py', 'ts', 'tsx', 'js', 'jsx', 'java', 'go', 'rs') then ['tree_sitter', 'semgrep'] "
    "when e in ('pdf', 'txt', 'md', 'docx', 'html', 'htm', 'rtf', 'csv', 'tsv', 'jsonl', 'json', 'yaml', 'yml', 'xml', 'toml') then ['nim_parser'] else ['skipped'] end a from p) "
    "select parser, count(*)::BIGINT n_files from (select unnest(a) parser from k) group by 1"
)
def route_summary(spark, d):
    each = _paths(spark, d).select(F.explode(F.when(paths.field_type(F.col("path")).isNull(), F.array(F.lit("skipped"))).otherwise(paths.parsers(F.col("path")))).alias("parser"))
    return each.groupBy("parser").agg(F.count(F.lit(1)).alias("n_files"))


_DIRS = ["src", "node_modules", ".git", "docs", "build", ".venv", "lib", "__pycache__", "app", "coverage", "tests", ".aws"]
_NAMES = ["main.py", "data.db", "old.bak", ".env", "notes.md", "server.key", "a.tmp", "app.log", "site.min.js", "x.sqlite3", "readme.txt"]
_DIRTY = f"(select doc_id, source || '/' || ([{', '.join(map(q, _DIRS))}])[doc_id % 12 + 1] || '/' || doc_id || '/' || ([{', '.join(map(q, _NAMES))}])[doc_id % 11 + 1] path from documents)"


@query(
    f"select doc_id, path, len(list_filter(string_split(path, '/'), lambda x: x in ('node_modules', '.git', 'build', '.venv', '__pycache__', 'coverage', '.aws', '.env') or regexp_matches(x, '[.](db|bak|key|tmp|log|min[.]js|sqlite3)$'))) > 0 ignored from {_DIRTY}"
)
def ignore_filter(spark, d):
    def pick(names: list[str]):
        return F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % len(names) + 1).cast("int"))

    p = t(spark, d, "documents").select("doc_id", F.concat_ws("/", "source", pick(_DIRS), F.col("doc_id").cast("string"), pick(_NAMES)).alias("path"))
    return p.select("doc_id", "path", paths.ignored(F.col("path")).alias("ignored"))


@query(
    "with h as (select page_id, url, lower(rtrim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.')) h from pages), a as (select *, h = 'example.com' or h like '%.example.com' ok from h) "
    "select page_id, regexp_matches(url, '^https?://') and ok url_ok, h = 'github.com' and starts_with(url, 'https://') and len(list_filter(string_split(substr(url, 20), '/'), lambda x: x <> '')) >= 2 repo_ok, ok remote_ok from a"
)
def url_rules(spark, d):
    url, allowed = F.col("url"), ["example.com"]
    remote = F.concat(F.lit("git@"), paths.host(url), F.lit(":team/project.git"))
    return t(spark, d, "pages").select("page_id", paths.url_ok(url, allowed).alias("url_ok"), paths.repo_url_ok(url).alias("repo_ok"), paths.git_remote_ok(remote, allowed).alias("remote_ok"))


_NETS = ["10.", "127.", "8.", "192.168.", "169.254.", "172.16.", "172.31.", "172.32.", "192.169."]


@query(
    f"with h as (select c_custkey, ([{', '.join(map(q, _NETS))}])[c_custkey % 9 + 1] p, c_custkey % 250 n from customer) select c_custkey, p || case when len(string_split(p, '.')) = 2 then '0.0.' else '0.' end || n host, "
    "p in ('10.', '127.', '192.168.', '169.254.', '172.16.', '172.31.') private from h"
)
def private_hosts(spark, d):
    p = F.element_at(F.array(*map(F.lit, _NETS)), (F.col("c_custkey") % 9 + 1).cast("int"))
    h = F.concat(p, F.when(F.size(F.split(p, "[.]")) == 2, "0.0.").otherwise("0."), (F.col("c_custkey") % 250).cast("string"))
    return t(spark, d, "customer").select("c_custkey", h.alias("host"), paths.private_address(h).alias("private"))


@query(
    "select doc_id, case when lang = 'en' then source || '/' || doc_id when lang = 'de' then 'doc' || doc_id else doc_id::VARCHAR end relative, case when lang = 'fr' then false else lang <> 'de' or source = 'src1' end contained from documents"
)
def path_containment(spark, d):
    path = F.when(F.col("lang") == "en", F.concat(F.lit("/data/root/"), "source", F.lit("/"), "doc_id")).when(F.col("lang") == "de", F.concat(F.lit("/data/rooted/"), F.lit("doc"), "doc_id"))
    path = path.when(F.col("lang") == "fr", F.concat(F.lit("/data/root/../"), "doc_id")).otherwise(F.concat(F.lit("/data/root/a/./../"), "doc_id"))
    inside = F.when((F.col("lang") == "de") & (F.col("source") == "src1"), F.concat(F.lit("sub/../"), "doc_id")).otherwise(path)
    relative = F.when(F.col("lang").isin("en", "de"), paths.relative_path(path, "/data/root")).otherwise(F.col("doc_id").cast("string"))
    return t(spark, d, "documents").select("doc_id", relative.alias("relative"), paths.contained(inside, "/data/root").alias("contained"))


@query(
    f"with p as (select doc_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) e from {_PATHS}) select doc_id, case e when 'md' then 'markdown' when 'csv' then 'csv' when 'json' then 'json' when 'html' then 'html' when 'toml' then 'toml' when 'jsonl' then 'jsonl' else 'text' end format from p"
)
def file_formats(spark, d):
    return _paths(spark, d).select("doc_id", paths.file_format(F.col("path")).alias("format"))


@query(
    f"with p as (select doc_id, lower(regexp_extract(path, '\\.([^./]+)$', 1)) e, octet_length(encode(text))::BIGINT * 1000 n from {_PATHS} join documents using (doc_id)) select doc_id, n n_bytes, case when n > 5242880 then 'too_large' end problem from p"
)
def size_rules(spark, d):
    sizes = t(spark, d, "documents").select("doc_id", (F.octet_length("text").cast("bigint") * 1000).alias("n_bytes"))
    return _paths(spark, d).join(sizes, "doc_id").select("doc_id", "n_bytes", paths.size_problem(F.col("path"), F.col("n_bytes")).alias("problem"))


@query("select o_orderkey, case when o_totalprice * 300 / 1048576 > 50 or o_orderkey * 50 > 500000 then 'reject' when o_totalprice * 300 / 1048576 > 5 or o_orderkey * 50 > 50000 then 'warn' else 'ok' end verdict from orders")
def csv_limits(spark, d):
    return t(spark, d, "orders").select("o_orderkey", csvprof.limits(F.col("o_totalprice") * 300, F.col("o_orderkey") * 50).alias("verdict"))


@query("select 'p_partkey' column_name, (count(*) filter (len(p_partkey::VARCHAR) > 12))::BIGINT n_long from part union all select 'p_name', (count(*) filter (len(p_name) > 12))::BIGINT from part union all select 'p_brand', (count(*) filter (len(p_brand) > 12))::BIGINT from part union all select 'p_type', (count(*) filter (len(p_type) > 12))::BIGINT from part union all select 'p_size', 0 union all select 'p_retailprice', (count(*) filter (len(p_retailprice::VARCHAR) > 12))::BIGINT from part")
def csv_long_cells(spark, d):
    return csvprof.long_cells(t(spark, d, "part"), 12)


@query("select 11::BIGINT column_count, count(*)::BIGINT row_count from lineitem")
def csv_summary(spark, d):
    return csvprof.summary(t(spark, d, "lineitem"))


@query("select c_custkey, '[REDACTED:' || length(c_name) || 'chars]' hidden from customer")
def mask_values(spark, d):
    return t(spark, d, "customer").select("c_custkey", redact.mask(F.col("c_name")).alias("hidden"))


@query(
    "select c_custkey, regexp_full_match(c_mktsegment, '[a-zA-Z0-9_-]{3,64}') and c_mktsegment not like '-%' project_ok, regexp_full_match(c_name, '[a-zA-Z0-9_@.\\-]{1,64}') vendor_ok from customer"
)
def validate_ids(spark, d):
    return t(spark, d, "customer").select("c_custkey", paths.project_id_ok(F.col("c_mktsegment")).alias("project_ok"), paths.vendor_id_ok(F.col("c_name")).alias("vendor_ok"))


@query()
def file_name_rules(spark, d):
    return _paths(spark, d).select("doc_id", paths.file_name_problem(F.col("path")).alias("problem"))


_ALLOWED = ["example.com", "example.org", "github.com"]


@query(
    "with h as (select page_id, lower(rtrim(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '.')) h from pages) select page_id, h host, h <> '' and ("
    + " or ".join(f"h = '{a}' or h like '%.{a}'" for a in _ALLOWED) + ") allowed from h"
)
def host_allowlist(spark, d):
    h = paths.host(F.col("url"))
    return t(spark, d, "pages").select("page_id", h.alias("host"), paths.host_allowed(h, _ALLOWED).alias("allowed"))


@query("with n as (select page_id, regexp_replace(regexp_extract(url, '([^/]*)/*$', 1), '\\.git$', '') n from pages) select page_id, case when length(n) < 3 then rpad(n, 3, '_') else n end project_id from n")
def project_of_url(spark, d):
    return t(spark, d, "pages").select("page_id", paths.project_of_url(F.col("url")).alias("project_id"))


@query("select page_id, regexp_replace('https://u:' || page_id || '@' || substr(url, 9), '//[^/@]*:[^/@]*@', '//', 'g') url from pages")
def credential_removal(spark, d):
    return t(spark, d, "pages").select("page_id", redact.hide_credentials(F.concat(F.lit("https://u:"), "page_id", F.lit("@"), F.substring("url", 9, 1 << 30))).alias("url"))


@query("select count(*)::BIGINT n_files, sum(octet_length(encode(text)))::BIGINT n_bytes from documents")
def collection_bounds(spark, d):
    files = t(spark, d, "documents").select(F.concat_ws("/", "source", "doc_id").alias("path"), F.octet_length("text").alias("length"))
    return S.bounds(files).select("n_files", F.col("n_bytes").cast("bigint").alias("n_bytes"))


@query(
    "with r as (select source, doc_id, sum(octet_length(encode(text))) over (partition by source order by doc_id) s from documents), o as (select *, row_number() over (partition by source order by doc_id) k from r where s > 50000) "
    "select source, doc_id, s::BIGINT so_far from o where k = 1"
)
def first_file_beyond(spark, d):
    docs = t(spark, d, "documents").select("source", "doc_id", F.octet_length("text").alias("b"))
    return S.first_beyond(docs, "source", "doc_id", "b", 50_000).withColumn("so_far", F.col("so_far").cast("bigint"))


# --- runs and snapshots ---

_RUNS = """r as (select o_orderkey::VARCHAR run_id, o_custkey::VARCHAR project_id, o_orderpriority ingest_source, case o_orderstatus when 'F' then 'active' when 'O' then 'superseded' else 'failed' end status,
o_orderdate created_at, o_orderkey % 7 file_count, floor(o_totalprice)::BIGINT snapshot_count, o_orderkey from orders)"""
_ACTIVE = "a as (select * from (select *, row_number() over (partition by project_id, ingest_source order by created_at desc, run_id desc) k from r where status = 'active') where k = 1)"


def _runs(spark, d):
    status = F.when(F.col("o_orderstatus") == "F", "active").when(F.col("o_orderstatus") == "O", "superseded").otherwise("failed")
    return t(spark, d, "orders").select(
        F.col("o_orderkey").cast("string").alias("run_id"), F.col("o_custkey").cast("string").alias("project_id"), F.col("o_orderpriority").alias("ingest_source"), status.alias("status"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderkey") % 7).alias("file_count"), F.floor("o_totalprice").cast("bigint").alias("snapshot_count"),
        F.lit("").alias("source_ref"), F.col("o_orderdate").alias("completed_at"),
    )


@query(f"with {_RUNS}, {_ACTIVE} select project_id, ingest_source, run_id active_run_id, created_at updated_at from a")
def active_runs(spark, d):
    return store.active_pointers(_runs(spark, d))


@query(f"with {_RUNS}, {_ACTIVE} select project_id, ingest_source, run_id active_run_id, status, file_count, snapshot_count from a")
def list_projects(spark, d):
    runs = _runs(spark, d)
    return store.list_projects(runs, store.active_pointers(runs)).select("project_id", "ingest_source", "active_run_id", "status", "file_count", "snapshot_count")


@query(
    f"with {_RUNS}, {_ACTIVE} select p.project_id, coalesce(sum(a.snapshot_count),0)::BIGINT snapshots, coalesce(sum(a.file_count),0)::BIGINT files, count(a.run_id)::BIGINT sources from (select distinct project_id from r) p left join a on a.project_id = p.project_id group by 1"
)
def project_totals(spark, d):
    runs = _runs(spark, d)
    return store.project_totals(runs, store.active_pointers(runs))


@query("select distinct o_custkey::VARCHAR project_id from orders")
def project_ids(spark, d):
    return _runs(spark, d).select("project_id").distinct()


@query(f"with {_RUNS} select run_id, project_id, ingest_source, status, (row_number() over (partition by project_id, ingest_source order by created_at desc, run_id desc))::INT place from r")
def run_history(spark, d):
    return store.history(_runs(spark, d)).select("run_id", "project_id", "ingest_source", "status", "place")


@query(
    f"with {_RUNS} select project_id, status, count(*)::BIGINT n_runs, sum(case when status in ('failed','draft') then 1 when status = 'active' then (file_count = 0)::INT + (snapshot_count = 0)::INT else 0 end)::BIGINT n_issues from r group by 1, 2"
)
def manifest_health(spark, d):
    return store.health(_runs(spark, d))


@query(f"with {_RUNS} select run_id from (select run_id, row_number() over (partition by project_id order by created_at desc, run_id desc) k from r where status in ('superseded','failed')) where k > 2")
def purge_old_runs(spark, d):
    return store.purgeable(_runs(spark, d)).select("run_id")


@query(f"with {_RUNS} select run_id from r where status = 'superseded' and created_at < (select max(created_at) from r) - interval 2 hours")
def stale_runs(spark, d):
    runs = _runs(spark, d).withColumn("status", F.when(F.col("status") == "superseded", "running").otherwise(F.col("status")))
    newest = runs.agg(F.max("created_at").alias("now"))
    return store.stale(runs.crossJoin(F.broadcast(newest)), F.col("now")).select("run_id")


@query(
    f"with a as (select l.doc_id, sha256(d.text) h from labels l join documents d using (doc_id)), b as (select doc_id, sha256({_RED}) h from documents where doc_id not in (select doc_id from labels where toxic = 1)) "
    "select coalesce(a.doc_id, b.doc_id) doc_id, case when a.doc_id is null then 'new' when b.doc_id is null then 'deleted' when a.h is not distinct from b.h then 'unchanged' else 'changed' end status from a full join b on a.doc_id = b.doc_id"
)
def run_diff(spark, d):
    """From the labelled documents to all that aren't labelled toxic, redacted: all four states occur."""
    docs, labels = t(spark, d, "documents"), t(spark, d, "labels")
    before = docs.join(labels.select("doc_id"), "doc_id").select("doc_id", F.sha2("text", 256).alias("content_hash"))
    after = docs.join(labels.where("toxic = 1").select("doc_id"), "doc_id", "left_anti").select("doc_id", F.sha2(redact.redact_secrets(text()), 256).alias("content_hash"))
    return store.diff(before, after, ["doc_id"])


@query("select d.doc_id, case when l.doc_id is null then d.source else 'labelled' end source, d.lang from documents d left join labels l using (doc_id)")
def payload_update(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source", "lang")
    return store.replace_payload(docs, t(spark, d, "labels").select("doc_id", F.lit("labelled").alias("source")), "doc_id", ["source"])


@query("select doc_id, max(case origin when 'a' then 1 else 2 end)::INT layer from (select doc_id, 'a' origin from documents union all select doc_id, 'b' from labels) group by 1")
def field_merge(spark, d):
    return store.last_wins([t(spark, d, "documents").select("doc_id", F.lit(1).alias("layer")), t(spark, d, "labels").select("doc_id", F.lit(2).alias("layer"))], ["doc_id"])


@query(
    f"with {_RUNS}, m as (select project_id p, ingest_source s from r where run_id = '1') select run_id, case when run_id = '1' then 'active' when status = 'active' and exists (select 1 from m where p = project_id and s = ingest_source) then 'superseded' else status end status from r"
)
def promote_run(spark, d):
    return store.promote(_runs(spark, d), "1").select("run_id", "status")


@query(
    f"with {_RUNS}, i as (select project_id, run_id, unnest([case when status = 'failed' then 'failed' end, case when status = 'active' and file_count = 0 then 'no files' end, case when status = 'active' and snapshot_count = 0 then 'no snapshots' end]) issue from r) select * from i where issue is not null"
)
def run_issues(spark, d):
    return store.issues(_runs(spark, d))


@query("select lang snapshot_type, 'doc_' || doc_id || '.txt' source_file from documents order by source_file, snapshot_type limit 50 offset 100")
def snapshot_page(spark, d):
    return notebook.search(_snapshots(spark, d).withColumn("status", F.lit("active")), status="all", offset=100).select("snapshot_type", "source_file")


_GRAMS = "list_distinct(list_transform(range(1, len(a) - 1), lambda i: a[i] || ' ' || a[i+1] || ' ' || a[i+2]))"


@query(
    f"with d as (select doc_id, unnest({_GRAMS}) g from (select doc_id, {TOK} a from documents) where len(a) >= 3), b as (select item_id, unnest({_GRAMS}) g from (select item_id, {TOK} a from benchmark) where len(a) >= 3), "
    "n as (select item_id, count(*) n from b group by 1) select doc_id, item_id, count(*)::BIGINT n_shared, round(count(*) / any_value(n), 6) share from d join b using (g) join n using (item_id) group by 1, 2 having count(*) >= any_value(n) * 0.5"
)
def benchmark_overlap(spark, d):
    return neardup.overlap(t(spark, d, "documents"), t(spark, d, "benchmark"), "doc_id", "text", "item_id", "text")


@query(
    f"with a as (select l.doc_id, sha256(d.text) h from labels l join documents d using (doc_id)), b as (select doc_id, sha256({_RED}) h from documents) "
    "select b.doc_id, case when a.doc_id is null then 'V001' when a.h is not distinct from b.h then 'V002' else 'V003' end event from b left join a on a.doc_id = b.doc_id"
)
def version_events(spark, d):
    docs = t(spark, d, "documents")
    known = docs.join(t(spark, d, "labels").select("doc_id"), "doc_id").select("doc_id", F.sha2("text", 256).alias("h"))
    return store.version_events(known, docs.select("doc_id", F.sha2(redact.redact_secrets(text()), 256).alias("h")), "doc_id", "h")


@query(
    "select o_custkey, o_orderkey, (row_number() over w)::INT version, (lag(o_orderkey) over w)::VARCHAR previous, lead(o_orderkey) over w is null is_current from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)"
)
def version_chain(spark, d):
    out = store.versions(t(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"])
    return out.select("o_custkey", "o_orderkey", "version", F.col("previous").cast("string").alias("previous"), "is_current")


@query("select source project_id, lang snapshot_type, sha256(coalesce(text,'')) content_hash, max(case when doc_id in (select doc_id from labels) then 'r1' else 'r0' end) run_id from documents group by 1,2,3")
def upsert_dedup(spark, d):
    rows = t(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("lang").alias("snapshot_type"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_hash"), "doc_id")
    first = rows.select("project_id", "snapshot_type", "content_hash", F.lit("r0").alias("run_id")).distinct()
    again = rows.join(t(spark, d, "labels").select("doc_id"), "doc_id", "left_semi").select("project_id", "snapshot_type", "content_hash", F.lit("r1").alias("run_id"))
    return store.upsert(first, again, ["project_id", "snapshot_type", "content_hash"])


@query("select doc_id, 'labels' origin from labels union all select doc_id, 'documents' from documents where doc_id not in (select doc_id from labels)")
def insert_if_absent(spark, d):
    return store.insert_if_absent(t(spark, d, "labels").select("doc_id", F.lit("labels").alias("origin")), t(spark, d, "documents").select("doc_id", F.lit("documents").alias("origin")), "doc_id")


@query("select doc_id, source from documents where source not in (select source from documents group by 1 order by count(*) desc, source limit 1)")
def delete_project(spark, d):
    docs = t(spark, d, "documents").select("doc_id", "source")
    largest = docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "source").limit(1)
    return store.delete_where(docs, largest, ["source"])


def _snapshots(spark, d):
    return t(spark, d, "documents").select(F.col("lang").alias("snapshot_type"), F.concat(F.lit("doc_"), "doc_id", F.lit(".txt")).alias("source_file"), "source", F.octet_length("text").alias("size"))


@query("select lang snapshot_type, 'doc_' || doc_id || '.txt' source_file, (count(*) over (partition by lang))::BIGINT n_of_type from documents where lang is not null")
def notebook_by_type(spark, d):
    return notebook.by_type(_snapshots(spark, d).where("snapshot_type is not null"))


@query("select source source_file, count(*)::BIGINT n_types, array_to_string(list(distinct lang order by lang), '|') types from documents where source is not null group by 1")
def notebook_by_file(spark, d):
    rows = notebook.by_file(t(spark, d, "documents").where("source is not null").select(F.col("source").alias("source_file"), F.col("lang").alias("snapshot_type")))
    return rows.withColumn("types", joined(F.col("types")))


@query("select count(*)::BIGINT n_snapshots, count(distinct doc_id)::BIGINT n_files, count(distinct lang)::BIGINT n_types from documents")
def notebook_summary(spark, d):
    return notebook.summary(_snapshots(spark, d))


@query(
    "select case grouping(lang, source) when 1 then 'type' when 2 then 'file' else 'total' end kind, case grouping(lang, source) when 1 then lang when 2 then source else '' end as name, count(*)::BIGINT n, round(sum(octet_length(encode(text)))/1024, 6) kb "
    "from documents group by grouping sets ((lang), (source), ())"
)
def snapshot_stats(spark, d):
    return notebook.stats(_snapshots(spark, d), "snapshot_type", "source", "size")


@query(
    "select count(*)::BIGINT attempted, count(*) filter (text is not null) processed, count(*) filter (text is null) failed, coalesce(sum(octet_length(encode(text))),0)::BIGINT source_bytes, "
    "count(*) filter (octet_length(encode(text)) < 500000) n_normal, count(*) filter (octet_length(encode(text)) >= 500000 and octet_length(encode(text)) < 5000000) n_large from documents"
)
def ingest_metrics(spark, d):
    files = t(spark, d, "documents").select(F.when(text().isNull(), "failed").otherwise("processed").alias("status"), T.size_tag(F.lit("doc"), text()).alias("tag"), F.octet_length("text").alias("size"))
    files = files.withColumn("tag", F.when(F.col("status") == "processed", F.col("tag")))
    return notebook.ingest_stats(files).select("attempted", "processed", "failed", F.col("source_bytes").cast("bigint").alias("source_bytes"), "n_normal", "n_large")


@query("select 'doc_' || doc_id || '.txt' source_file, lang snapshot_type from documents where lang = 'en' and 'doc_' || doc_id || '.txt' like '%7%' order by 1, 2 limit 50")
def snapshot_search(spark, d):
    return notebook.search(_snapshots(spark, d).withColumn("status", F.lit("active")), snapshot_type="en", fragment="7").select("source_file", "snapshot_type")


# --- findings, chats, logs, limits ---


def _findings_sql() -> str:
    rules = " union all ".join(f"select doc_id, i::BIGINT line, {q(r.rule_id)} rule_id, {q(r.severity)} severity, {q(r.message)} message, x from l where regexp_matches(x, {q(r.pattern)})" for r in findings.RULES)
    return f"with a as (select doc_id, string_split(text, chr(10)) a from documents), l as (select doc_id, unnest(range(1, len(a)+1)) i, unnest(a) x from a), f as ({rules}) "


_CAT = """case when severity in ('ERROR','WARNING') then case when regexp_matches(rule_id, 'secret|password|token') then 'hardcoded_secrets' when regexp_matches(rule_id, 'sql|injection') then 'sql_injection_risks'
when regexp_matches(rule_id, 'xss|cross-site') then 'xss_risks' else 'vulnerabilities' end when regexp_matches(lower(message), 'todo|fixme') then 'todos' when contains(lower(message), 'deprecated') then 'deprecated_usage'
when regexp_matches(lower(message), 'anti|pattern') then 'antipatterns' else 'code_smells' end"""


@query(_findings_sql() + f"select {_CAT} category, rule_id, count(*)::BIGINT n from f group by 1, 2")
def findings_by_category(spark, d):
    found = findings.scan(t(spark, d, "documents"), "doc_id", "text")
    return found.groupBy(findings.category(F.col("severity"), F.col("rule_id"), F.col("message")).alias("category"), "rule_id").agg(F.count(F.lit(1)).alias("n"))


@query(_findings_sql() + "select f.doc_id, rule_id, line, x as match, array_to_string(a.a[greatest(line-3,1):line-1], '|') before, array_to_string(a.a[line+1:line+3], '|') after from f join a on a.doc_id = f.doc_id")
def findings_context(spark, d):
    found = findings.scan(t(spark, d, "documents"), "doc_id", "text")
    return found.select("doc_id", "rule_id", "line", "match", joined(F.col("before")).alias("before"), joined(F.col("after")).alias("after"))


@query(_findings_sql() + "select d.doc_id, count(f.doc_id)::BIGINT n_findings from documents d left join f on f.doc_id = d.doc_id group by 1")
def findings_by_file(spark, d):
    docs = t(spark, d, "documents")
    return findings.by_file(docs.select("doc_id"), findings.scan(docs, "doc_id", "text"), "doc_id").select("doc_id", F.size("findings").cast("bigint").alias("n_findings"))


@query(
    "select conv_id, count(*)::BIGINT n_turns, string_agg('## ' || upper(role[1]) || role[2:] || chr(10) || chr(10) || trim(text, ' ') || chr(10), chr(10) order by turn, text) markdown "
    "from conversations where role in ('user','assistant') and trim(coalesce(text,''), ' ') <> '' group by 1"
)
def chat_to_markdown(spark, d):
    return logs.chat_markdown(t(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@query()
def rate_limit(spark, d):
    return limits.limit(t(spark, d, "events"), "event_id", "event_type", "ts")


@query(
    '''select event_id, event_type, (count(*) over w)::BIGINT in_window, (count(*) over w) <= 100 as "within" from events
window w as (partition by event_type order by ts range between interval '59.999999 seconds' preceding and current row)'''
)
def rate_limit_window(spark, d):
    return limits.sliding_counts(t(spark, d, "events"), "event_type", "ts", "event_id")


_LEVEL = "case when value > 90 then 'ERROR' when value > 50 then 'WARNING' else 'INFO' end"


@query(f"with e as (select event_id, ts, {_LEVEL} as level from events), l as (select * from e order by ts desc, event_id desc limit 300) select event_id, level from l where level in ('WARNING','ERROR') order by ts desc, event_id desc limit 100")
def log_filter(spark, d):
    level = F.when(F.col("value") > 90, "ERROR").when(F.col("value") > 50, "WARNING").otherwise("INFO")
    return logs.log_tail(t(spark, d, "events").select("event_id", "ts", level.alias("level")), ["ts", "event_id"], "level", "WARNING", 100).select("event_id", "level")


@query("select event_type, count(*)::BIGINT n, round(avg(value), 6) avg_ms, min(value) min_ms, max(value) max_ms from events group by 1")
def stage_timing(spark, d):
    return notebook.timing(t(spark, d, "events"), "event_type", "value")


@query("select event_id, event_type, value from events order by value desc, event_id limit 5")
def slowest_five(spark, d):
    return notebook.slowest(t(spark, d, "events"), "value", "event_id").select("event_id", "event_type", "value")


@query("select item_id, '<item><id>' || item_id || '</id><text>' || replace(replace(replace(text,'&','&amp;'),'<','&lt;'),'>','&gt;') || '</text></item>' as xml from benchmark")
def xml_records(spark, d):
    return t(spark, d, "benchmark").select("item_id", logs.xml_record("item", {"id": F.col("item_id"), "text": text()}).alias("xml"))


@query()
def packed_roundtrip(spark, d):
    """Each document as one packed snapshot, unpacked again."""
    docs = t(spark, d, "documents").where("text is not null")
    values = F.to_json(F.struct(F.col("source").alias("code.file.path"), F.col("n_chars").alias("code.file.loc"), F.array("lang", "source").alias("code.imports.modules")))
    slots = F.array(F.lit(1), F.lit(2)).cast("array<bigint>")
    rows = docs.select(F.col("doc_id").alias("id"), T.type_id(F.lit("file_metadata")).alias("type_number"), values.alias("values"), F.sha2("text", 256).alias("content_hash"), "text", slots.alias("minhash"))
    return packed.round_trip(rows).withColumnRenamed("id", "doc_id")


@query(
    f"with x as (select source project_id, text, sha256(text) h, {_RED} <> text secret, case when octet_length(encode(text)) >= 10000000 then 'rejected' when octet_length(encode(text)) >= 5000000 then 'potential_god' when octet_length(encode(text)) >= 500000 then 'large' else 'normal' end tag from documents) "
    "select project_id, count(*)::BIGINT n_files, count(distinct h)::BIGINT n_contents, (count(*) - count(distinct h))::BIGINT n_duplicates, (count(*) filter (tag = 'normal'))::BIGINT n_normal, (count(*) filter (tag <> 'normal'))::BIGINT n_large, (count(*) filter (secret))::BIGINT n_with_secrets from x group by 1"
)
def project_overview(spark, d):
    """Per project: files, distinct contents, duplicates, sizes, and files with a redacted secret."""
    docs = t(spark, d, "documents").select(
        F.col("source").alias("project_id"), F.sha2("text", 256).alias("h"), T.size_tag(F.lit("doc"), text()).alias("tag"), (redact.redact_secrets(text()) != text()).alias("secret")
    )
    # contents are counted within (project, hash) first, so that a project of any size is spread over tasks
    kinds = docs.groupBy("project_id", "h").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("tag") == "normal").alias("normal"), F.count_if("secret").alias("secrets"))
    sums = kinds.groupBy("project_id").agg(F.sum("n").alias("n_files"), F.count("h").alias("n_contents"), F.sum("normal").alias("n_normal"), F.sum("secrets").alias("n_with_secrets"))
    return sums.select("project_id", "n_files", "n_contents", (F.col("n_files") - F.col("n_contents")).alias("n_duplicates"), "n_normal", (F.col("n_files") - F.col("n_normal")).alias("n_large"), "n_with_secrets")


@query()
def field_registry(spark, d):
    return R.field_registry(spark)

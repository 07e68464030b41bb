"""Registered queries of the text operators, each next to its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recordaudit.llm import (chat, decontaminate, hard_negatives, html_text, learned_partitions, line_dedup, mixing, near_dedup, periodic_runs,
                             pii, quality, secrets, suffix_dedup)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a (spark, folder) -> DataFrame function under ``name``."""

    def add(function):
        QUERIES[name] = function
        if sql is not None:
            SQL[name] = sql
        return function

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


MIX_SQL = r"""
with sized as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size,
         md5(concat('mix-1:', coalesce(doc_id::varchar, 'null'))) as k
  from {documents}),
src as (select source, sum(size)::bigint as source_size from sized group by source),
ranked as (
  select *, row_number() over (order by source is null, source) as r, source_size * 3 as lim from src),
weighted as (select *, ((r - 1) % 3 + 1)::bigint as w from ranked),
filled as (
  select *, sum(source_size) over () - coalesce(sum(lim) over b, 0) as rest,
         sum(w) over () - coalesce(sum(w) over b, 0) as shares
  from weighted window b as (order by lim / w, r rows between unbounded preceding and 1 preceding)),
marked as (select *, lim * shares <= rest * w as stopped, lim / w as o from filled),
free as (select rest as f_rest, shares as f_shares from marked where not stopped order by o, r limit 1),
tgt as (
  select source, source_size, r,
         case when stopped then lim::double else (f_rest * w)::double / f_shares::double end as target
  from marked left join free on true),
seats as (
  select *, sum(target) over (order by r rows between unbounded preceding and unbounded following) as total, count(*) over () as n from tgt),
around as (
  select *, floor(total / 4 + 0.5)::bigint as m, case when total > 0 then target / total else 0.0 end as share from seats),
certain as (
  select *, floor(m * share + 0.5)::bigint as about, (ceil(2 * n * share) + 2)::bigint as spread from around),
opened as (select *, greatest(about - spread, 0) as sure, m - sum(greatest(about - spread, 0)) over () as open_seats from certain),
cand as (select *, unnest(range(sure + 1, about + spread + 1)) as seat from opened),
placed as (select *, row_number() over (order by target / (2 * seat - 1) desc, r, seat) as place from cand),
given as (
  select source, source_size, target, least((min(sure) + sum(case when place <= open_seats and target > 0 then 1 else 0 end)) * 4, source_size * 3)::bigint as q
  from placed group by source, source_size, target),
origin as (
  select *, (('0x' || substr(md5(concat('mix-1/', coalesce(source, ''))), 1, 12))::bigint
             % greatest(ceil(source_size / 4)::bigint, 1)) * 4 as o, greatest(source_size, 1) as len
  from given),
spots as (
  select *, coalesce(sum(size) over (partition by source order by k, doc_id, size rows between unbounded preceding and 1 preceding), 0) as a
  from sized)
select a.doc_id, a.size, g.source_size, g.target,
       (((g.o + g.q) // g.len) * a.size + least(greatest((g.o + g.q) % g.len - a.a, 0), a.size)
        - (g.o // g.len) * a.size - least(greatest(g.o % g.len - a.a, 0), a.size))::bigint as taken
from spots a join origin g on a.source is not distinct from g.source
"""


@query("op10_mix_sources", MIX_SQL.replace("{documents}", "documents"))
def mix_sources(spark, folder):
    return mixing.mix(table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


QUALITY_SQL = r"""
with w as (
  select rowid_, doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words
  from (select row_number() over () as rowid_, doc_id, text from {documents})),
m as (
  select rowid_, doc_id, text, words, len(words)::bigint as n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::bigint as word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::bigint as n_symbols,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from w),
g as (
  select rowid_, p, words[p] || ' ' || words[p + 1] || ' ' || words[p + 2] as gram
  from (select rowid_, words, unnest(range(1, len(words) - 1)) as p from w where len(words) >= 3)),
d as (select rowid_, p from g qualify count(*) over (partition by rowid_, gram) > 1),
c as (
  select rowid_, sum(least(3, coalesce(nxt - p, 3)))::bigint as n_repeat_words
  from (select rowid_, p, lead(p) over (partition by rowid_ order by p) as nxt from d) group by rowid_),
f as (
  select m.*, coalesce(c.n_repeat_words, 0)::bigint as n_repeat_words, len(lines)::bigint as n_lines,
         (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines,
         len(list_filter(words, lambda x: regexp_matches(x, '\p{L}')))::bigint as n_letters
  from m left join c using (rowid_)),
b as (
  select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed from f),
q as (
  select *, not base_failed and n_symbols * 10 <= n_words and (n_dup_lines < 3 or n_dup_lines * 10 <= n_lines * 3)
         and word_chars >= n_words * 3 and word_chars <= n_words * 12
         and length(regexp_replace(text, '[A-Z]', '', 'g')) * 2 >= length(text)
         and n_letters * 10 >= n_words * 7 as kept
  from b)
"""


@query("op2_quality_rules", QUALITY_SQL.replace("{documents}", "documents")
       + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept from q")
def quality_rules(spark, folder):
    return quality.judge(table(spark, folder, "documents")).select(
        "doc_id", F.col("m_n_words").alias("n_words"), F.col("m_word_chars").alias("word_chars"),
        F.col("m_n_symbols").alias("n_symbols"), F.col("m_n_dup_lines").alias("n_dup_lines"),
        F.col("m_n_repeat_words").alias("n_repeat_words"), F.col("m_base_failed").alias("base_failed"),
        F.col("m_rejected_by").isNull().alias("kept"))


CHAT_SQL = r"""
with m as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (
  select *, replace(replace(role, '\', '\\'), '<|', '<\|') as erole, replace(replace(text, '\', '\\'), '<|', '<\|') as etext from m)
select conv_id, count(*)::bigint as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, etext)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, etext) filter (role = 'assistant'), '')) as loss_sha256,
       sum(23 + length(erole) + length(etext))::bigint as formatted_chars
from e group by conv_id
"""


@query("op3_chat_format", CHAT_SQL)
def chat_format(spark, folder):
    said = r"\### Assistant: </turn> ok"
    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn int, role string, text string")
    read = chat.read_back(chat.format_chats(given.unionByName(extra)))
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(turns, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"))


PII_SQL = r"""
with t as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from {documents}),
g as (
  select rid, 'email' as kind, 0 as ord, regexp_extract_all(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as m,
         string_split_regex(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+') as p from t
  union all
  select rid, 'ip', 1, regexp_extract_all(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)'),
         string_split_regex(text, '[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)') from t
  union all
  select rid, 'card', 2, regexp_extract_all(text, '[0-9](?:[\x20-]?[0-9])+'), string_split_regex(text, '[0-9](?:[\x20-]?[0-9])+') from t
  union all
  select rid, 'phone', 3, regexp_extract_all(text, '\+[0-9][\x20().0-9-]+[0-9]'), string_split_regex(text, '\+[0-9][\x20().0-9-]+[0-9]') from t
  union all
  select rid, 'iban', 4, regexp_extract_all(text, '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?'),
         string_split_regex(text, '[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?') from t),
u as (select rid, kind, ord, m, p, unnest(range(1, len(m) + 1)) as i from g where len(m) > 0),
s as (
  select rid, kind, ord, m[i] as x, sum(length(p[i])) over w + coalesce(sum(length(m[i])) over v, 0) as st
  from u window w as (partition by rid, kind order by i rows between unbounded preceding and current row),
                v as (partition by rid, kind order by i rows between unbounded preceding and 1 preceding)),
n as (select *, regexp_replace(x, '[^0-9]', '', 'g') as d, replace(x, ' ', '') as a from s),
ok as (
  select rid, kind, ord, st::bigint as st, (st + length(x))::bigint as en from n
  where case kind
    when 'email' then true
    when 'ip' then list_bool_and(list_transform(string_split(x, '.'), lambda y: y::hugeint <= 255))
    when 'card' then length(d) between 12 and 19 and list_sum(list_transform(range(1, length(d) + 1),
      lambda j: case when j % 2 = 1 then substr(d, length(d) - j + 1, 1)::int
           else substr(d, length(d) - j + 1, 1)::int * 2 - case when substr(d, length(d) - j + 1, 1)::int > 4 then 9 else 0 end end)) % 10 = 0
    when 'phone' then length(d) between 9 and 15
    when 'iban' then length(a) between 15 and 34 and
      list_reduce(list_concat([0::bigint], list_transform(range(1, length(a) + 1), lambda j: ascii(substr(substr(a, 5) || substr(a, 1, 4), j, 1))::bigint)),
        lambda q, c: case when c < 58 then (q * 10 + c - 48) % 97 else (q * 100 + c - 55) % 97 end) = 1 end),
agg as (
  select rid, count(*) filter (kind = 'email') as n_email, count(*) filter (kind = 'ip') as n_ip,
         count(*) filter (kind = 'card') as n_card, count(*) filter (kind = 'phone') as n_phone,
         string_agg(kind || ':' || st || ':' || en, ',' order by st, ord) filter (kind <> 'iban') as base,
         string_agg(kind || ':' || st || ':' || en, ',' order by st, ord) as spans
  from ok group by rid)
select doc_id, coalesce(n_email, 0)::bigint as n_email, coalesce(n_ip, 0)::bigint as n_ip, coalesce(n_card, 0)::bigint as n_card,
       coalesce(n_phone, 0)::bigint as n_phone, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from t left join agg using (rid)
"""

@query("op5_personal_data", PII_SQL.replace("{documents}", "documents"))
def personal_data(spark, folder):
    found = pii.find(table(spark, folder, "documents").select("doc_id", "text"))
    base = pii.of_kinds(F.col("pii"), [k.name for k in pii.KINDS if k.base])
    count = lambda kind: F.size(pii.of_kinds(F.col("pii"), [kind])).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("email"), count("ip"), count("card"), count("phone"),
        F.sha2(pii.joined(base), 256).alias("base_sha256"), pii.joined(F.col("pii")).alias("spans"))


@query("op4_secrets")
def find_secrets(spark, folder):
    found = secrets.find(table(spark, folder, "documents"))
    base = F.filter("spans", lambda s: s["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"),
                        F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


NEAR_SQL = r"""
with recursive w as (
  select row_number() over () as rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as words
  from {documents}),
sets as (
  select rid, doc_id, case when len(words) = 0 then [] when len(words) < 5 then [array_to_string(words, ' ')]
         else list_distinct(list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))) end as s
  from w),
sh as (select rid, unnest(s) as g from sets),
common as (select a.rid as x, b.rid as y, count(*) as n from sh a join sh b on a.g = b.g and a.rid <> b.rid group by 1, 2),
links as (
  select x, y from common join sets a on a.rid = x join sets b on b.rid = y
  where 100 * n >= 85 * (len(a.s) + len(b.s) - n)),
reach(rid, other) as (
  select rid, rid from sets
  union
  select r.rid, l.y from reach r join links l on l.x = r.other)
select s.doc_id, len(s.s)::bigint as n_shingles, min(o.doc_id) as component_id, s.doc_id = min(o.doc_id) as kept
from sets s join reach r using (rid) join sets o on o.rid = r.other
group by s.rid, s.doc_id, s.s
"""


@query("op1_near_duplicates", NEAR_SQL.replace("{documents}", "documents"))
def near_duplicates(spark, folder):
    return near_dedup.near_duplicates(table(spark, folder, "documents"))


@query("op9_benchmark_leaks")
def benchmark_leaks(spark, folder):
    return decontaminate.find_leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query("op7_html_text")
def html_main_text(spark, folder):
    return html_text.main_text(table(spark, folder, "pages"))


LINES_SQL = r"""
with d as (select distinct doc_id, coalesce(text, '') as text from {documents}),
l as (
  select doc_id, text, i, trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as x
  from (select doc_id, text, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from d)),
n as (
  select *, row_number() over w as n, lead(x, 1) over w as x2, lead(x, 2) over w as x3,
         len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) as words, len(regexp_extract_all(lead(x, 1) over w, '[^\x20\x09-\x0D]+')) as words2
  from l where x <> '' window w as (partition by doc_id, text order by i)),
p as (
  select *, row_number() over (partition by x order by doc_id, n) > 1 as c1,
         x2 is not null and row_number() over (partition by x, x2 order by doc_id, n) > 1 as c2,
         x3 is not null and row_number() over (partition by x, x2, x3 order by doc_id, n) > 1 as c3
  from n),
gone as (
  select doc_id, text, n from p where c1 and words >= 20
  union select doc_id, text, n + unnest([0, 1]) from p where c2 and words + words2 >= 20
  union select doc_id, text, n + unnest([0, 1, 2]) from p where c3),
k as (
  select l.doc_id, l.text, l.i, l2.x as raw, g.n is not null as out
  from l
  join (select doc_id, text, unnest(string_split(text, chr(10))) as x, unnest(range(len(string_split(text, chr(10))))) as i from d) l2
    on l.doc_id = l2.doc_id and l.text = l2.text and l.i = l2.i
  left join p on p.doc_id = l.doc_id and p.text = l.text and p.i = l.i
  left join gone g on g.doc_id = p.doc_id and g.text = p.text and g.n = p.n)
select doc_id, count(*) filter (out)::bigint as lines_removed,
       sha256(coalesce(string_agg(raw, chr(10) order by i) filter (not out), '')) as kept_sha256
from k group by doc_id, text
"""


@query("op6_repeated_lines", LINES_SQL.replace("{documents}", "documents"))
def repeated_lines(spark, folder):
    return line_dedup.drop_repeats(table(spark, folder, "documents")).select(
        "doc_id", "lines_removed", F.sha2("text", 256).alias("kept_sha256"))


@query("op8_repeated_substrings")
def repeated_substrings(spark, folder):
    return suffix_dedup.drop_repeats(table(spark, folder, "documents")).select(
        "doc_id", "n_bytes", F.coalesce(F.aggregate("removed", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"]), F.lit(0).cast("long")).alias("n_removed"),
        F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


NEGATIVES_SQL = """
with v as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)) as q
  from {embeddings}
  where vec_id is not null and label is not null and embedding is not null and len(embedding) > 0
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
u as (select * from v where len(q) = (select len(q) from v group by 1 order by count(*) desc, 1 desc limit 1)),
s as (
  select a.rid, a.vec_id as anchor_id, a.label as la, b.rid as other, b.vec_id, b.label, list_inner_product(a.q, b.q)::bigint as score
  from u a join u b on a.vec_id % 100 = 0 and a.rid <> b.rid),
p as (
  select * from (select rid, anchor_id, la, vec_id as positive_id, score as positive_score,
                        row_number() over (partition by rid order by score desc, vec_id) as place
                 from s where label = la and vec_id <> anchor_id) where place <= 5),
n as (
  select p.*, s.vec_id as negative_id, s.score as negative_score,
         row_number() over (partition by p.rid, p.place order by s.score desc, s.vec_id) as rank
  from p join s on s.rid = p.rid and s.label <> p.la and 80 * positive_score <= 100 * s.score and 100 * s.score <= 100 * positive_score)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from n where rank <= 5
"""


@query("op11_hard_negatives", NEGATIVES_SQL.replace("{embeddings}", "embeddings"))
def mined_negatives(spark, folder):
    rows = table(spark, folder, "embeddings").select(
        "vec_id", "embedding", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0)


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, text): one document in ten, by the checksum of its id, goes round in circles from one of its words on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    planted = docs.select("doc_id", "text", h.alias("h"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("w"))
    n, g = F.size("w"), F.floor(F.col("h") / 10)
    spots = planted.withColumn("a", F.when(n > 0, (g % n).cast("int"))).withColumn(
        "p", F.when(n > 0, (1 + F.floor((n - F.col("a")) / (3 + g % 8))).cast("int")))
    # Word i is word a + (i - a) % p from word a on; numbers start at 0.
    around = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.get("w", F.when(
        i < F.col("a"), i).otherwise(F.col("a") + F.pmod(i - F.col("a"), F.col("p")))))
    return spots.select("doc_id", F.when(n > 0, F.array_join(around, " ")).otherwise(F.col("text")).alias("text"))


@query("op12_periodic_runs")
def repeated_periods(spark, folder):
    found = periodic_runs.collapse_runs(with_planted_runs(table(spark, folder, "documents")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("before"), (-r["period"]).alias("least"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    length, period = F.col("top.length"), -F.col("top.least")
    return found.withColumn("top", longest).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("top.before")).alias("start"), length.alias("length"),
        period.alias("period"), F.floor(1000 * length / period).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise(F.lit("")), 256).alias("runs_sha256"),
        F.sha2("text", 256).alias("collapsed_sha256"))


@query("op13_nearest_neighbours")
def nearest_neighbours(spark, folder):
    found = learned_partitions.search(table(spark, folder, "embeddings"), F.col("vec_id") % 100 == 0)
    return found.select("query_id", "rank", F.col("neighbour_id").alias("vec_id"), "score")

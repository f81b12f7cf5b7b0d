"""The corpus operators bound to the test tables, and the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from murmur.llm import (
    bpe, conversations, decontaminate, exact_dedup, hard_negatives, language, line_dedup, mixing, near_dedup, repeats, token_counts, token_files, url_filter,
)
from murmur.session import scratch_path

RULES = [
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts.count_tokens(table(spark, sf_dir, "documents"))
    return counts.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = exact_dedup.dedup_stream(spark, f"{sf_dir}/documents.parquet")
    return judged.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.find_repeats(table(spark, sf_dir, "documents"))
    cut = found.cut.select(
        "k1", "k2", F.sha2("kept", 256).alias("cut_sha256"), F.size("spans").cast("long").alias("runs"), F.length("kept").cast("long").alias("n_kept")
    )
    judged = found.documents.join(cut, ["k1", "k2"], "left").withColumn("n_kept", F.coalesce("n_kept", "n_bytes"))
    return judged.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.col("n_kept")).alias("n_removed"),
        F.coalesce("runs", F.lit(0).cast("long")).alias("n_spans"), F.coalesce("cut_sha256", "sha256").alias("kept_sha256"),
        "n_kept", F.col("runs").isNotNull().alias("has_repeats"),
    )


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    token_files.write_token_files(table(spark, sf_dir, "documents"), path)
    return token_files.read_token_files(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return lines.select("doc_id", "n_lines", "n_removed", "n_links", "classes", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predict_languages(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations")
    found = conversations.audits(given, conversations.repair(conversations.damage(given)))
    return found.withColumn("repaired_sha256", F.sha2(F.encode("repaired", "UTF-8"), 256)).drop("repaired")


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.decode_documents(bpe.encode_documents(table(spark, sf_dir, "documents")))
    n_tokens = F.call_function("div", F.octet_length("ids"), F.lit(4)).cast("long")
    return coded.select("doc_id", n_tokens.alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("text", "UTF-8"), 256).alias("decoded_sha256"))


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


OP4_SQL = """
with n as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) text_sha256
  from documents)
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, text_sha256
from n window w as (partition by text_sha256)
"""

OP5_SQL = """
with rules(rule_host, rule_path, rule_verdict) as (values
  ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
  ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
rest as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) else '' end r from pages),
parts as (select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host,
  regexp_extract(substr(r, length(regexp_extract(r, '^[^/?#]*')) + 1), '^[^?#]*') path from rest),
urls as (select distinct host, path from parts),
best as (select host, path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) as rule,
    arg_max(rule_verdict, length(rule_host || rule_path)) verdict
  from urls, rules
  where (host = rule_host or ends_with(host, '.' || rule_host)) and starts_with(path, rule_path) group by 1, 2)
select page_id, host, path, rule, coalesce(verdict, 'allow') verdict from parts left join best using (host, path)
"""

OP11_SQL = """
with recursive keyed as (select *, coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as k from conversations),
given as (select conv_id, turn, coalesce(role, ' ') r, coalesce(text, ' ') t,
  xor(list_reduce(list_transform(string_split(k, ''), lambda x: ascii(x)::bigint),
    lambda c, b: list_reduce(range(8), lambda v, i: xor(v >> 1, (v & 1) * 3988292384), xor(c, b)), 4294967295::bigint), 4294967295::bigint) % 20 kind
  from keyed),
damaged as (select conv_id, turn, case when kind = 4 then 'user' else r end as role,
    case when kind = 1 then '' when kind = 2 then regexp_replace(t, '[.!?]', '', 'g') else t end as text,
    unnest(case when kind = 3 then [1, 2] else [1] end) as copy from given where kind <> 0),
ordered as (select *, row_number() over (partition by conv_id order by turn nulls first, role, sha256(strlen(role) || ':' || role || text)) n from damaged),
judged as (select *, not regexp_matches(text, '[^\\x20\\x09-\\x0D]') blank, row_number() over (partition by conv_id, role, text order by n) > 1 again,
    not regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') cut_off, lag(role[1]) over (partition by conv_id order by n) || role[1] as pair from ordered),
turns as (select *, blank or again as dead, case when cut_off then 5 else 0 end as extra from judged),
paths(conv_id, n, state, cost, audit, lines) as (
  select conv_id, 0::bigint, v.state, v.cost, v.audit, v.lines from (select distinct conv_id from turns), (values
    (0, 0, '', []::varchar[]), (2, 5, 'I', ['user:']), (3, 10, 'II', ['user:', 'assistant:'])) v(state, cost, audit, lines)
  union all
  select conv_id, n, state, cost, audit, lines from (
    select conv_id, n, state, cost, audit, lines, row_number() over (partition by conv_id, state order by cost, audit) best from (
      select conv_id, n, i.state, e.cost + i.cost as cost, e.audit || i.letters as audit, list_concat(e.lines, i.lines) as lines from (
        select conv_id, n, x.state as state, cost + x.cost as cost, audit || x.letter as audit, case when x.line is null then lines else list_append(lines, x.line) end as lines
        from (select p.conv_id, t.n, p.cost, p.audit, p.lines, unnest(list_filter([
            {'state': p.state, 'cost': 2, 'letter': 'D', 'line': null::varchar},
            {'state': case when t.dead then null when t.role[1] = 's' and p.state = 0 then 1 when t.role[1] = 'u' and p.state <> 2 then 2
              when t.role[1] = 'a' and p.state = 2 then 3 end, 'cost': t.extra, 'letter': 'K', 'line': t.role || ':' || t.text},
            {'state': case when t.dead then null when p.state = 2 then 3 else 2 end, 'cost': 1 + t.extra, 'letter': 'R',
              'line': case when p.state = 2 then 'assistant:' else 'user:' end || t.text}], lambda x: x.state is not null)) x
          from paths p join turns t on t.conv_id is not distinct from p.conv_id and t.n = p.n + 1)) e,
      (values (0, 0, '', []::varchar[], 0), (1, 0, '', [], 1), (2, 0, '', [], 2), (3, 0, '', [], 3),
        (0, 5, 'I', ['user:'], 2), (1, 5, 'I', ['user:'], 2), (2, 5, 'I', ['assistant:'], 3), (3, 5, 'I', ['user:'], 2),
        (0, 10, 'II', ['user:', 'assistant:'], 3), (1, 10, 'II', ['user:', 'assistant:'], 3)) i(was, cost, letters, lines, state)
      where i.was = e.state)) where best = 1),
counted as (select conv_id, count(*) n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (where blank) blank,
    count(*) filter (where not blank and again) duplicate, count(*) filter (where not dead and cut_off) truncated,
    count(*) filter (where pair not in ('su', 'ua', 'au')) illegal from turns group by conv_id),
best as (select p.conv_id, p.cost, p.audit, p.lines from paths p join counted c on c.conv_id is not distinct from p.conv_id and c.n = p.n
  where p.state in (0, 3) qualify row_number() over (partition by p.conv_id order by p.cost, p.audit) = 1)
select o.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0) blank, coalesce(duplicate, 0) duplicate, coalesce(truncated, 0) truncated,
  coalesce(illegal, 0) illegal, coalesce(cost, 0)::bigint as cost, coalesce(audit, '') audit, sha256(coalesce(array_to_string(lines, chr(10)), '')) repaired_sha256
from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id
  left join best b on b.conv_id is not distinct from o.conv_id
"""

OP13_SQL = """
with v as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end l,
    list_transform(embedding, lambda x: floor(256 * x::double)::bigint) v
  from embeddings where label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id anchor_id, b.vec_id, a.l = b.l same, list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2]))::bigint score
  from v a, v b where a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id positive_id, score positive_score from s where same
  qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select anchor_id, positive_id, (row_number() over (partition by anchor_id, positive_id order by s.score desc, s.vec_id))::int as rank,
  s.vec_id negative_id, positive_score, s.score negative_score
from p join s using (anchor_id) where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10
"""

QUERIES = {
    "op1_token_counts": (op1_token_counts, None),
    "op2_decontaminate": (op2_decontaminate, None),
    "op3_near_dedup": (op3_near_dedup, None),
    "op4_exact_dedup": (op4_exact_dedup, OP4_SQL),
    "op5_url_filter": (op5_url_filter, OP5_SQL),
    "op6_repeats": (op6_repeats, None),
    "op7_token_files": (op7_token_files, None),
    "op8_line_dedup": (op8_line_dedup, None),
    "op9_language": (op9_language, None),
    "op10_mixing": (op10_mixing, None),
    "op11_conversation_repair": (op11_conversation_repair, OP11_SQL),
    "op12_bpe": (op12_bpe, None),
    "op13_hard_negatives": (op13_hard_negatives, OP13_SQL),
}


def queries() -> dict:
    return {name: query for name, (query, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in QUERIES.items() if sql}

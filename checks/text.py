"""Text operators on whole documents and posts: duplicates, entities, sentiment."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks.binding import ENTITIES_SQL, POSTS_SQL, all_posts, entities, fixture_dictionary, table, ts_text, with_ctes
from murmur.functions import fixed_values as fv
from murmur.functions.stats import sentiment_label
from murmur.functions.text import copypaste_fingerprint
from murmur.operators import dedup, entities as ents, sentiment
from murmur.session import scratch_path
from murmur.sources.dictionary import Dictionary, enrich_entities, entries_to_terms, read_entries

# A dictionary over words that occur in the documents, so that every rule fires.
DOC_DICTIONARY = Dictionary.build(
    {
        "DE": {"name": "De", "sector": "A", "aliases": ["de la", "der der"]},
        "CI": {"name": "Ci", "sector": "A", "aliases": ["of the", "the and the"]},
        "LA": {"name": "La", "sector": "B", "aliases": ["eriner thanea", "thanea"]},
        "ON": {"name": "On", "sector": "B", "aliases": ["is the"]},
        "QUE": {"name": "Que", "sector": "C", "aliases": ["que ci", "the the"]},
        "THE": {"name": "The", "sector": "C", "aliases": []},
        "ERHE": {"name": "Erhe", "sector": "C", "aliases": ["in the", "and of"]},
        "WAS": {"name": "Was", "sector": "D", "aliases": ["was the", "die"]},
    },
    blocklist=["THE", "AND", "OF"],
    ambiguous=["ON"],
)
DOC_BULL = {"of the": 2.0, "and": 1.0, "thanea": 1.5, "very": 0.5}
DOC_BEAR = {"de la": 1.2, "is the": 0.8, "that": 0.4}


def _documents(spark, d):
    """Documents as posts: later ids arrive later, length stands for engagement."""
    docs = table(spark, d, "documents")
    return docs.select(
        F.col("doc_id").cast("string").alias("id"),
        F.timestamp_seconds(F.lit(1_700_000_000) + F.col("doc_id")).alias("ts"),
        F.col("n_chars").alias("engagement"),
        F.col("source").alias("platform"),
        "text",
    )


def fingerprints(spark, d):
    return table(spark, d, "documents").select("doc_id", copypaste_fingerprint(F.col("text")).alias("fp"))


def collapse_near_duplicates(spark, d):
    return dedup.collapse_near_duplicates(_documents(spark, d)).select("id", "engagement", ts_text("ts").alias("ts"))


def collapse_posts(spark, d):
    """Short posts pass through untouched."""
    kept = dedup.collapse_near_duplicates(all_posts(spark, d).drop("k"))
    return kept.groupBy("platform").agg(F.count("*").alias("posts"), F.sum("engagement").alias("engagement"))


def dedupe_posts(spark, d):
    """One post per (platform, author): their id is made to collide."""
    p = all_posts(spark, d).drop("k").withColumn("id", F.concat_ws(":", "platform", "author"))
    return dedup.dedupe_posts(p).select("id", "engagement", F.unix_micros("ts").alias("ts_us"))


def cashtags(spark, d):
    p = all_posts(spark, d)
    found = ents.cashtags(F.col("text"), fixture_dictionary())
    return p.select("id", F.array_join(F.array_sort(found), ",").alias("found"))


def tag_posts(spark, d):
    """Post texts tagged from scratch, counted per symbol."""
    p = all_posts(spark, d).withColumn("tickers", F.array().cast("array<string>"))
    tagged = ents.tag_posts(p, fixture_dictionary())
    return tagged.select(F.explode("tickers").alias("ticker")).groupBy("ticker").agg(F.count("*").alias("posts"))


def bare_symbols(spark, d):
    found = ents.bare_symbols(F.col("text"), DOC_DICTIONARY)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(found), ",").alias("found"))


def alias_symbols(spark, d):
    found = ents.alias_symbols(F.col("text"), DOC_DICTIONARY)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(found), ",").alias("found"))


def extract_tickers(spark, d):
    found = ents.extract_tickers(F.col("text"), DOC_DICTIONARY)
    return table(spark, d, "documents").select("doc_id", F.array_join(F.array_sort(found), ",").alias("found"))


def extract_tickers_by_join(spark, d):
    """The table form of the dictionary must give the same symbols."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "text", F.array().cast("array<string>").alias("tickers"))
    tagged = ents.tag_posts_by_join(docs, DOC_DICTIONARY.terms(spark), DOC_DICTIONARY.max_words())
    return tagged.select(F.col("id").alias("doc_id"), F.array_join(F.array_sort("tickers"), ",").alias("found"))


def _part_entries(spark, d):
    """A dictionary written as lines: every part is an entity named by its words; some symbols are blocked."""
    path = scratch_path(spark, "dictionary")
    part = table(spark, d, "part")
    symbol = F.concat(F.lit("P"), F.col("p_partkey").cast("string"))
    words = F.split(F.lower("p_name"), " ")
    entries = part.select(
        symbol.alias("ticker"), F.col("p_name").alias("name"), F.col("p_brand").alias("sector"),
        F.when(F.col("p_partkey") % 5 != 0, F.array(F.lower("p_name"), words[0])).alias("aliases"),
        F.when(F.col("p_partkey") % 9 == 0, symbol).alias("blocked"),
    )
    entries.write.json(path)
    return read_entries(spark, path)


def loaded_dictionary(spark, d):
    """The terms of a dictionary read back from its files."""
    return entries_to_terms(_part_entries(spark, d), ambiguous=["P7", "P11"])


def loaded_entities(spark, d):
    return _part_entries(spark, d).select("ticker", "name", "sector", F.size(F.coalesce("aliases", F.array().cast("array<string>"))).alias("n_aliases"))


def entity_enrichment(spark, d):
    counts = all_posts(spark, d).select(F.explode("tickers").alias("ticker")).groupBy("ticker").agg(F.count("*").alias("n"))
    return enrich_entities(counts, entities(spark))


def lexicon_sentiment(spark, d):
    return sentiment.score_posts_lexicon(all_posts(spark, d)).select("id", "sentiment", "sentiment_score")


def lexicon_documents(spark, d):
    raw = sentiment.lexicon_raw(F.col("text"), bull=DOC_BULL, bear=DOC_BEAR)
    return table(spark, d, "documents").select("doc_id", F.round(raw, 6).alias("raw"))


def finance_lexicon_documents(spark, d):
    score = sentiment.lexicon_score(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.round(score, 4).alias("score"), sentiment_label(score).alias("label"))


def _values(bull, bear) -> str:
    rows = [(p, w) for p, w in bull.items()] + [(p, -w) for p, w in bear.items()]
    return ", ".join("('{}', {}::double)".format(p.replace("'", "''"), w) for p, w in rows)


WORD = r"[\p{L}\p{N}_]"


def lexicon_sql(source: str, key: str, bull, bear) -> str:
    """Per row of ``source`` (key, text): the signed phrase sum ``raw``."""
    factors = " * ".join(
        f"(case when ends_with(rtrim(prefix, ' ' || chr(9) || chr(10) || chr(13)), '{w}') then {m}::double else 1.0::double end)"
        for w, m in fv.INTENSIFIERS.items()
    )
    return rf"""
lex(phrase, w) as (values {_values(bull, bear)}),
cut as (select s.{key} key, phrase, w, string_split(' ' || lower(s.text) || ' ', phrase) parts
        from {source} s join lex on contains(' ' || lower(s.text) || ' ', phrase)),
occ as (select key, phrase, w, right(list_reduce(parts[1:i], lambda a, b: a || phrase || b), 30) prefix
        from (select *, unnest(range(1, len(parts))) i from cut)),
raws as (select key, sum(w * (case when regexp_matches(prefix, '(^|[^\p{{L}}\p{{N}}_])(not|no|never|isn''t|aren''t|won''t|don''t|doesn''t|wasn''t)\s+({WORD}+\s+){{0,2}}$') then -0.8::double else 1.0::double end) * {factors}) raw
         from occ group by key)
"""


FP_SQL = r"""
norm as (select *, array_to_string(regexp_extract_all(regexp_replace(lower(text), 'https?://\S+', ' ', 'g'), '[a-z0-9$]+'), ' ') n from {source}),
fps as (select *, case when length(n) >= 80 then substr(sha1(n), 1, 16) end fp from norm)
"""

FOLD = "regexp_replace(text, '[À-ÖØ-öø-ɏ]', 'z', 'g')"
FOLD_LOWER = "regexp_replace(lower(text), '[À-ÖØ-öø-ɏ]', 'z', 'g')"


def _quoted(values) -> str:
    return ", ".join(f"'{v}'" for v in sorted(values))


def _bare_sql(dic: Dictionary) -> str:
    allowed = set(dic.symbols) - dic.ambiguous - dic.blocklist
    return rf"list_filter(regexp_extract_all({FOLD}, '\b([A-Z][A-Z.]{{1,5}})\b', 1), lambda s: s in ({_quoted(allowed)}))"


def _cash_sql(dic: Dictionary) -> str:
    return (
        rf"list_filter(list_transform(regexp_extract_all({FOLD}, '\$([A-Za-z][A-Za-z.]{{0,5}})\b', 1), lambda s: upper(s)), "
        rf"lambda s: s in ({_quoted(dic.symbols)}) or (regexp_matches(s, '^[A-Z]{{2,5}}$') and s not in ({_quoted(dic.blocklist) or chr(39)*2})))"
    )


def _alias_sql(dic: Dictionary) -> str:
    parts = [rf"case when regexp_matches({FOLD_LOWER}, '\b{a}\b') then '{s}' end" for a, s in dic.aliases]
    return f"list_filter([{', '.join(parts)}], lambda s: s is not null)"


def _set_text(expr: str) -> str:
    return f"array_to_string(list_sort(list_distinct({expr})), ',') found"


PARTS_SQL = "parts as (select *, 'P' || p_partkey ticker from part)"
FIX = fixture_dictionary()

QUERIES = {
    "fingerprints": (fingerprints, with_ctes(FP_SQL.format(source="documents")) + "select doc_id, fp from fps"),
    "collapse_near_duplicates": (
        collapse_near_duplicates,
        with_ctes(FP_SQL.format(source="documents"))
        + "select min(doc_id)::varchar id, cast(sum(n_chars) as bigint) engagement, strftime(make_timestamp((1700000000 + min(doc_id)) * 1000000), '%Y-%m-%d %H:%M:%S') ts "
        "from fps group by coalesce(fp, 'doc' || doc_id)",
    ),
    "collapse_posts": (collapse_posts, with_ctes(POSTS_SQL) + "select platform, count(*) posts, cast(sum(engagement) as bigint) engagement from allposts group by 1"),
    "dedupe_posts": (
        dedupe_posts,
        with_ctes(POSTS_SQL)
        + "select platform || ':' || author id, engagement, epoch_us(ts) ts_us from allposts qualify row_number() over (partition by platform, author order by engagement desc, ts) = 1",
    ),
    "cashtags": (cashtags, with_ctes(POSTS_SQL) + f"select id, {_set_text(_cash_sql(FIX))} from allposts"),
    "tag_posts": (
        tag_posts,
        with_ctes(POSTS_SQL)
        + f"select ticker, count(*) posts from (select id, unnest(list_distinct(list_concat({_cash_sql(FIX)}, {_bare_sql(FIX)}, {_alias_sql(FIX)}))) ticker from allposts) group by 1",
    ),
    "bare_symbols": (bare_symbols, f"select doc_id, {_set_text(_bare_sql(DOC_DICTIONARY))} from documents"),
    "alias_symbols": (alias_symbols, f"select doc_id, {_set_text(_alias_sql(DOC_DICTIONARY))} from documents"),
    "extract_tickers": (
        extract_tickers,
        f"select doc_id, {_set_text('list_concat(' + _cash_sql(DOC_DICTIONARY) + ', ' + _bare_sql(DOC_DICTIONARY) + ', ' + _alias_sql(DOC_DICTIONARY) + ')')} from documents",
    ),
    "extract_tickers_by_join": (
        extract_tickers_by_join,
        f"select doc_id, {_set_text('list_concat(' + _cash_sql(DOC_DICTIONARY) + ', ' + _bare_sql(DOC_DICTIONARY) + ', ' + _alias_sql(DOC_DICTIONARY) + ')')} from documents",
    ),
    "loaded_dictionary": (
        loaded_dictionary,
        with_ctes(PARTS_SQL)
        + "select 'cashtag' kind, ticker term, ticker, 0::int as rank from parts "
        "union all select 'bare', ticker, ticker, 0 from parts where p_partkey % 9 <> 0 and ticker not in ('P7', 'P11') "
        "union all select distinct 'alias', a, ticker, -length(a) from (select ticker, unnest([lower(p_name), string_split(lower(p_name), ' ')[1]]) a from parts where p_partkey % 5 <> 0) "
        "union all select 'blocked', ticker, null, 0 from parts where p_partkey % 9 = 0",
    ),
    "loaded_entities": (
        loaded_entities,
        with_ctes(PARTS_SQL) + "select ticker, p_name as name, p_brand sector, case when p_partkey % 5 <> 0 then 2 else 0 end n_aliases from parts",
    ),
    "entity_enrichment": (
        entity_enrichment,
        with_ctes(POSTS_SQL, ENTITIES_SQL)
        + "select ticker, n, coalesce(e.name, ticker) as name, coalesce(e.sector, 'Other') sector from "
        "(select ticker, count(*) n from (select t1 ticker from allposts union all select t2 from allposts where t2 is not null and t2 <> t1) group by 1) left join entities e using (ticker)",
    ),
    "lexicon_sentiment": (
        lexicon_sentiment,
        with_ctes(POSTS_SQL, lexicon_sql("allposts", "id", fv.BULL_PHRASES, fv.BEAR_PHRASES))
        + "select id, round(tanh(coalesce(raw, 0.0) / 4), 4) sentiment_score, case when tanh(coalesce(raw, 0.0) / 4) > 0.12 then 'bull' "
        "when tanh(coalesce(raw, 0.0) / 4) < -0.12 then 'bear' else 'neutral' end sentiment from allposts left join raws on raws.key = id",
    ),
    "lexicon_documents": (
        lexicon_documents,
        with_ctes(lexicon_sql("documents", "doc_id", DOC_BULL, DOC_BEAR)) + "select doc_id, round(coalesce(raw, 0.0), 6) raw from documents left join raws on raws.key = doc_id",
    ),
    "finance_lexicon_documents": (
        finance_lexicon_documents,
        with_ctes(lexicon_sql("documents", "doc_id", fv.BULL_PHRASES, fv.BEAR_PHRASES))
        + "select doc_id, round(tanh(coalesce(raw, 0.0) / 4), 4) score, case when tanh(coalesce(raw, 0.0) / 4) > 0.12 then 'bull' "
        "when tanh(coalesce(raw, 0.0) / 4) < -0.12 then 'bear' else 'neutral' end as label from documents left join raws on raws.key = doc_id",
    ),
}

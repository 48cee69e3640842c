"""The registered queries of this subpackage, with production parameters, and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from reelshelf.llm.runtime import read_table


def op1_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from reelshelf.llm.bpe import token_digests

    return token_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.langid import predict_languages

    return predict_languages(read_table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.suffixes import suffix_digests

    return suffix_digests(read_table(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.quality import quality_rules

    return quality_rules(read_table(spark, sf_dir, "documents"))


def op5_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from reelshelf.llm.chat import chat_digests

    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = r"\### Assistant: </turn> ok"
    turns = F.array(*(F.struct(F.lit(at).cast("long").alias("turn"), F.lit(role).alias("role")) for at, role in enumerate(("user", "assistant"))))
    more = spark.range(1).select(F.lit(-7).cast("long").alias("conv_id"), F.inline(turns), F.lit(text).alias("text"))
    return chat_digests(rows.unionByName(more))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.mixing import mix_plan

    return mix_plan(read_table(spark, sf_dir, "documents"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.htmltext import extract_texts

    return extract_texts(read_table(spark, sf_dir, "pages"))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.jaccard import similar_groups

    return similar_groups(read_table(spark, sf_dir, "documents"))


#: Bytes of text in a shard.
SHARD_BYTES = 1 << 20


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.sharding import shard_table

    return shard_table(read_table(spark, sf_dir, "documents"), SHARD_BYTES)


def op10_syncmer_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.syncmers import fingerprint_table

    return fingerprint_table(read_table(spark, sf_dir, "documents"))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.prefixtrie import prefix_trie

    return prefix_trie(read_table(spark, sf_dir, "conversations"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.spelling import spelling_groups

    return spelling_groups(read_table(spark, sf_dir, "documents"))


def op13_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from reelshelf.llm.linedup import line_digests

    return line_digests(read_table(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_bpe_encode_decode, op2_language_id, op3_suffix_dedup, op4_quality_rules, op5_chat_formatting, op6_source_mix, op7_html_extraction,
        op8_ngram_jaccard, op9_sharding, op10_syncmer_fingerprints, op11_prefix_trie, op12_spelling_variants, op13_line_dedup,
    )
}

#: Words and white space as in the contracts.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

#: Half-byte steps of the crc32 polynomial.
_CRC = []
for _step in range(16):
    for _ in range(4):
        _step = _step >> 1 ^ 0xEDB88320 * (_step & 1)
    _CRC.append(_step)


def _crc32(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of a text's UTF-8 bytes (code points below 2048)."""
    half = lambda c, b: f"xor({c} >> 4, list_extract({_CRC}, 1 + (xor({c}, {b}) & 15)))"
    codes = f"list_transform(string_split({text}, ''), lambda x: unicode(x)::bigint)"
    utf8 = f"flatten(list_transform({codes}, lambda x: case when x < 128 then [x] else [192 + (x >> 6), 128 + (x & 63)] end))"
    halves = f"flatten(list_transform({utf8}, lambda x: [x & 15, x >> 4]))"
    return f"xor(4294967295, list_reduce({halves}, lambda c, b: {half('c', 'b')}, 4294967295::bigint))"


_LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

SQL: dict[str, str] = {
    "op4_quality_rules": f"""
        with docs as (
            select row_number() over () as row, doc_id, coalesce(text, '') as text, source, {_WORDS} as ws,
                list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls
            from documents),
        windows as (
            select row, unnest(range(1, len(ws) - 3)) as i, unnest(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' '))) as gram
            from docs where len(ws) >= 5),
        again as (select row, i from (select *, count(*) over (partition by row, gram) as c from windows) where c > 1),
        covered as (
            select row, sum(step) as words from (
                select row, least(5, coalesce(lead(i) over (partition by row order by i) - i, 5)) as step from again) group by row),
        norms as (
            select row, source, pos, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789', 'abcdefghijklmnopqrstuvwxyz0000000000'),
                '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm
            from (select row, source, unnest(ls) as line, generate_subscripts(ls, 1) as pos from docs)),
        wholes as (select row, string_agg(norm, chr(10) order by pos) as whole from norms group by row),
        frequent as (
            select source, norm from norms join wholes using (row) group by source, norm having count(distinct whole) > 50),
        removed as (
            select row, sum(len(string_split(n.norm, ' '))) as words
            from norms n join frequent f on n.norm = f.norm and n.source is not distinct from f.source group by row),
        measured as (
            select doc_id, cast(len(ws) as bigint) as n_words, cast(length(array_to_string(ws, '')) as bigint) as word_chars,
                cast(length(text) - length(translate(text, '#*$%&|<>', '')) as bigint) as n_symbols,
                cast(len(ls) - len(list_distinct(ls)) as bigint) as n_dup_lines, cast(coalesce(c.words, 0) as bigint) as n_repeat_words,
                cast(coalesce(r.words, 0) as bigint) as removed_words
            from docs left join covered c using (row) left join removed r using (row))
        select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed,
            not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and 100 * (n_words - removed_words) >= 20 * n_words as kept
        from measured""",
    "op6_source_mix": f"""
        with sizes as (
            select doc_id, source, cast(len({_WORDS}) as bigint) as size,
                cast(cast('0x' || substr(md5('20|' || coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 13) as bigint) as double)
                    / 4503599627370496.0 as draw
            from documents),
        sources as (
            select source, cast(sum(size) as bigint) as source_size,
                [5.0, 2.0, 1.0][(row_number() over (order by source is null, source) - 1) % 3 + 1] as weight
            from sizes group by source),
        filled as (
            select *, 2.0 * source_size as cap, sum(2.0 * source_size) over w - 2.0 * source_size as fixed,
                sum(weight) over () - (sum(weight) over w - weight) as open, 1.5 * sum(source_size) over () as everything
            from sources window w as (order by 2.0 * source_size / weight, source rows unbounded preceding)),
        level as (
            select cast((everything - fixed) as double) / cast(open as double) as level from filled
            where (everything - fixed) / open <= cap / weight order by cap / weight limit 1)
        select doc_id, size, source_size, target, cast(floor(rate) + (draw < rate - floor(rate))::int as bigint) as copies,
            cast(size * (floor(rate) + (draw < rate - floor(rate))::int) as bigint) as taken
        from (select s.*, f.source_size, f.target, case when f.source_size > 0 then f.target / f.source_size else 0.0 end as rate
            from sizes s join (
                select source, source_size, least(cast(cap as double), cast(weight as double) * coalesce((select level from level), 0.0)) as target from filled
            ) f on s.source is not distinct from f.source)""",
    "op9_sharding": f"""
        with hashed as (
            select row_number() over () as row, doc_id, cast(coalesce(strlen(text), 0) as bigint) as n_bytes,
                cast('0x' || substr(md5(coalesce(cast(doc_id as varchar), '') || '|' || coalesce(text, '')), 1, 15) as bigint) as h
            from documents),
        levels as (select *, h >> (60 - depth) as bucket from hashed, (select unnest(range(0, 61)) as depth)),
        buckets as (
            select depth, bucket, cast(sum(n_bytes) as bigint) as shard_bytes, count(*) as shard_docs
            from levels group by depth, bucket having sum(n_bytes) <= {SHARD_BYTES} or min(h) = max(h) or depth = 60)
        select doc_id, n_bytes, case when depth = 0 then '' else right(bin(bucket + (1::bigint << 61)), depth) end as shard,
            cast(depth as int) as depth, shard_bytes, shard_docs
        from (select l.*, shard_bytes, shard_docs, row_number() over (partition by l.row order by l.depth) as k
            from levels l join buckets b on l.depth = b.depth and l.bucket = b.bucket)
        where k = 1""",
    "op11_prefix_trie": f"""
        with turns as (
            select conv_id as c, row_number() over (partition by conv_id order by turn nulls first) as pos,
                md5(coalesce(role, '')) || md5(coalesce(text, '')) as k, length(coalesce(text, '')) as size
            from conversations where conv_id is not null),
        convs as (select c, {_crc32("c::varchar")} % 6 as h from (select distinct c from turns)),
        own as (
            select v.c, t.pos, t.k, t.size from convs v join turns t on t.c = v.c - v.c % 100 where t.pos <= v.h
            union all select v.c, t.pos, t.k, t.size from convs v join turns t on t.c = v.c where t.pos > v.h),
        seqs as (select c, list(k order by pos) as ks, list(size order by pos) as sizes from own group by c
            union all select c, [], [] from convs where c not in (select c from own)),
        steps as (select c, unnest(range(0, len(ks) + 1)) as d, ks, sizes from seqs),
        nodes as (
            select array_to_string(ks[1:d], '') as p, d, min(c) as c, count(*) as n, coalesce(any_value(sizes[d]) filter (where d > 0), 0) as size,
                sha256(coalesce(string_agg(c::varchar, ',' order by c) filter (where len(ks) = d), '')) as ends
            from steps group by array_to_string(ks[1:d], ''), d),
        children as (select left(p, (d - 1) * 64) as p, count(*) as n from nodes where d > 0 group by 1),
        own_sums as (select n.p, n.d, (n.n - 1) * n.size as saved, (c.n is null)::int as leaf from nodes n left join children c using (p)),
        sums as (
            select p, cast(sum(saved) as bigint) as saved, cast(sum(leaf) as bigint) as leaves
            from (select left(p, k * 64) as p, saved, leaf from (select *, unnest(range(0, d + 1)) as k from own_sums)) group by p)
        select n.c as conv_id, cast(n.d as bigint) as depth, a.c as parent_conv_id, n.n as n_convs, coalesce(k.n, 0) as n_children,
            s.leaves as n_leaves, s.saved as saved_tokens, n.ends as ends_sha256
        from nodes n join sums s using (p) left join children k using (p)
        left join nodes a on n.d > 0 and a.p = left(n.p, (n.d - 1) * 64)""",
    "op12_spelling_variants": f"""
        with recursive runs as (
            select coalesce(doc_id::varchar, '') as id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), {_LOWER}) as run from documents),
        hashed as (select id, run, {_crc32("id || ':' || run")} as h from runs where length(run) >= 7),
        words as (
            select word, count(*) as n
            from (select case when h % 31 = 0 then left(run, h % length(run)) || substr(run, h % length(run) + 2) else run end as word from hashed)
            where length(word) >= 7 group by word having count(*) >= 2),
        shorter as (select word, k, left(word, k) || substr(word, k + 2) as rest from (select word, unnest(range(0, length(word))) as k from words)),
        near as (
            select a.word, b.word as other from shorter a join shorter b on a.k = b.k and a.rest = b.rest and a.word <> b.word
            union select s.word, w.word from shorter s join words w on s.rest = w.word
            union select w.word, s.word from shorter s join words w on s.rest = w.word),
        ranked as (
            select near.word, other, w.n as other_n, count(*) over (partition by near.word) as n_near, row_number() over (partition by near.word order by w.n desc, other) as k
            from near join words w on w.word = near.other),
        best as (select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 10 * w.n then other end as form, case when other_n >= 10 * w.n then other_n end as form_n
            from words w left join (select * from ranked where k = 1) r on r.word = w.word),
        roots as (
            select word, word as root, form as following from best
            union all select r.word, b.word, b.form from roots r join best b on b.word = r.following)
        select b.word, b.form, r.root, b.n, b.n_near, b.form_n from best b join roots r on r.word = b.word where r.following is null""",
    "op13_line_dedup": f"""
        with docs as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as ls from documents),
        lines as (select row, doc_id, unnest(ls) as line, generate_subscripts(ls, 1) as pos from docs),
        keyed as (select *, translate(trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)), {_LOWER}) as k from lines),
        frequent as (select k from (select distinct row, k from keyed where k <> '') group by k having count(*) >= 10)
        select doc_id, count(*) as n_lines, count(f.k) as n_dropped,
            sha256(coalesce(string_agg(line, chr(10) order by pos) filter (where f.k is null), '')) as kept_sha256
        from keyed left join frequent f on keyed.k = f.k group by row, doc_id""",
}

"""SQL for the queries, written for DuckDB from the tables alone."""

from __future__ import annotations

import re

from quern.functions.text import WHITESPACE
from quern.operators.mixing import MAX_PER_SOURCE
from quern.suite.queries import (
    BANNED,
    BANNED_LETTERS,
    CONTEXT,
    DELIVERIES,
    HEAD,
    INSTRUCTION,
    PATTERNS,
    PHRASE_WORDS,
    PHRASES,
    QUICK_ROWS,
    REDACTED,
    VOCABULARY,
)


def literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _strip(text: str) -> str:
    return f"trim({text}, {literal(WHITESPACE)})"


def _starts(pattern: str, text: str = "text") -> str:
    """(match, start) pairs of a pattern: gaps and matches before it give a match's offset."""
    found = f"regexp_extract_all({text}, {literal(pattern)}, 0, 'i')"
    gaps = f"regexp_split_to_array({text}, {literal(pattern)}, 'i')"
    before = (
        f"list_sum(list_transform(({gaps})[1:i], lambda g: length(g))) + "
        f"coalesce(list_sum(list_transform(({found})[1:i-1], lambda g: length(g))), 0)"
    )
    return (
        f"list_transform(range(1, len({found}) + 1), "
        f"lambda i: {{'m': ({found})[i], 'start': cast({before} as integer)}})"
    )


def _counting(pattern: str) -> str:
    window = "lower(substr(text, greatest(h.start - 120, 0) + 1, h.start - greatest(h.start - 120, 0)))"
    excused = " or ".join(f"contains({window}, {literal(k)})" for k in CONTEXT)
    kept = f"list_filter({_starts(pattern)}, lambda h: not ({excused}))"
    return f"list_transform({kept}, lambda h: h.m)"


_PHRASES_FOUND = "list_concat(" + ", ".join(_counting(p) for p in PATTERNS) + ")"
_EXCERPT = "left(replace(text, chr(10), ' '), 300)"
_ANNOTATED = f"select doc_id, text, n_chars, {_PHRASES_FOUND} as phrases from documents"


def _split_words(table: str, row_id: str) -> str:
    split = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')"
    return f"(select {row_id}, {split} as w from {table})"


def _runs(table: str, row_id: str) -> str:
    """Every run of PHRASE_WORDS words with its place."""
    return f"""select {row_id}, array_to_string(w[i:i + {PHRASE_WORDS - 1}], ' ') as phrase, cast(i - 1 as integer) as start
        from (select *, unnest(range(1, len(w) - {PHRASE_WORDS - 2})) as i from {_split_words(table, row_id)})"""


_LISTED_PLACES = f"""select doc_id, phrase, start from ({_runs("documents", "doc_id")})
        where phrase in (select phrase from ({_runs("benchmark", "item_id")}))"""


def _contains_any(words, text: str) -> str:
    return "(" + " or ".join(f"contains({text}, {literal(w)})" for w in words) + ")"


def _hits() -> str:
    parts = []
    for phrase in PHRASES:
        severity = min(5, max(1, len(phrase) // 10))
        pattern = re.sub(r"([^\w ])", r"\\\1", phrase)
        parts.append(
            f"select doc_id, {literal(phrase)} as phrase, h.start as start, "
            f"h.start + {len(phrase)} as \"end\", {severity} as severity "
            f"from (select doc_id, unnest({_starts(pattern)}) as h from documents)"
        )
    return " union all ".join(parts)


def _redacted() -> str:
    text = "text"
    for phrase in sorted(REDACTED, key=len, reverse=True):
        text = f"regexp_replace({text}, {literal(phrase)}, '[REDACTED]', 'gi')"
    return text


_TALK_SEQ = "conv_id * 100 + turn"
_SOURCES = (
    "select doc_id as seq, text, 0 as source_rank from documents",
    f"select {_TALK_SEQ} as seq, text, 1 as source_rank from conversations",
    "select item_id as seq, text, 2 as source_rank from benchmark",
)
_WORDS = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


def _vocabulary(rows: str) -> str:
    return (
        f"select token, n as count, cast(row_number() over (order by n desc, token) + 1 as integer) as token_id "
        f"from (select token, count(*) as n from (select unnest({_WORDS}) as token from {rows}) "
        f"group by token) qualify row_number() over (order by n desc, token) <= {VOCABULARY}"
    )


def _coded(rows: str, key: str, length: int) -> str:
    """CTEs: ``coded`` has the key and unpadded ids of every row of ``rows``."""
    return (
        f"vocab as ({_vocabulary(rows)}), "
        f"words as (select {key}, {_WORDS}[1:{length}] as ws from {rows}), "
        f"places as (select {key}, unnest(ws) as token, generate_subscripts(ws, 1) as pos from words), "
        f"found as (select {key}, list(coalesce(token_id, 1) order by pos) as ids "
        f"from places left join vocab using (token) group by {key}), "
        f"coded as (select {rows}.*, coalesce(ids, []) as ids from {rows} left join found using ({key}))"
    )


def _padded(length: int) -> str:
    return f"list_concat(ids, list_transform(range({length} - len(ids)), lambda i: cast(0 as integer)))"


def _shown(values: str) -> str:
    return f"array_to_string({values}, ' ')"


def _mask(length: int) -> str:
    return f"list_transform(range({length}), lambda i: case when i < len(ids) then 1 else 0 end)"


def _split(key: str, rows: str) -> str:
    return (
        f"case when row_number() over (order by md5({key})) <= ceil(0.1 * (select count(*) from {rows})) "
        f"then 'test' else 'train' end"
    )


_TRAINING = (
    f"with rows as (select source_rank, seq, concat({literal(INSTRUCTION)}, text) as text, "
    f"source_rank || '|' || seq as id from ({_SOURCES[0]} union all {_SOURCES[1]}) "
    f"where not {_contains_any(BANNED, 'lower(text)')}), " + _coded("rows", "id", 260) + ", marked as "
    f"(select *, {_split(chr(39) + '42|' + chr(39) + ' || id', 'rows')} as split from coded)"
)

_NEIGHBOURS = (
    "select q.vec_id as query_id, d.vec_id as doc_id, "
    "list_sum(list_transform(range(1, len(q.embedding) + 1), lambda i: "
    "(q.embedding[i]::double - d.embedding[i]::double) * (q.embedding[i]::double - d.embedding[i]::double))) as d2 "
    "from embeddings q, embeddings d"
)
_RANKED = (
    f"select query_id, doc_id, d2, row_number() over (partition by query_id order by d2, doc_id) as rank "
    f"from ({_NEIGHBOURS}) qualify rank <= 5"
)
_KNN = f"select query_id, doc_id, round(d2, 6) as d2, cast(rank as integer) as rank from ({_RANKED})"

_STATUS = "case event_type when 'error' then 'failed' when 'view' then 'skipped' else 'success' end"
_HOST = "regexp_extract(url, '^[a-z]+://([^/]+)', 1)"
_PARTS = "string_split(regexp_replace(url, '^[a-z]+://', ''), '/')"
_FILES = (
    f"select '/old' as root, case ({_PARTS})[2] when 'en' then 'models' when 'de' then 'datasets' else 'cache' end "
    f"as category, case when ({_PARTS})[1] like 'm.%' then '.' else '' end || ({_PARTS})[1] as entry, "
    f"({_PARTS})[3] as leaf, length(html) as length from pages"
)
_VISIBLE = f"select * from ({_FILES}) where entry not like '.%'"
_FOLDER = "case category when 'models' then '/new/models' when 'datasets' then '/new/datasets' else '/new/cache' end"
_STAMP = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"

SQL: dict[str, str] = {
    "normalise_text": f"""
        select * from (select doc_id, {_strip(
            "case when lang = 'fr' then '  ' || chr(10) else chr(12288) || chr(10) || ' ' || text || chr(9) || ' ' end"
        )} as text from documents) where length(text) > 0""",
    "dedup_exact_first": """
        select doc_id, lang, source, n_chars from documents
        where doc_id in (select min(doc_id) from documents group by text)""",
    "dedup_report": f"""
        select doc_id, row_number() over (partition by {_strip("text")} order by doc_id) > 1 as is_duplicate
        from documents""",
    "root_dedup": f"""
        select page_id, root, row_number() over (partition by lower(root) order by page_id) > 1 as is_duplicate
        from (select page_id, case when page_id % 2 = 0 then upper({_HOST}) else {_HOST} end as root from pages)""",
    "flag_context": f"""
        select doc_id, array_to_string(phrases, '|') as matched_phrases, {_EXCERPT} as excerpt
        from ({_ANNOTATED}) where len(phrases) > 0
        and doc_id in (select min(doc_id) from documents group by text)""",
    "flag_split_counts": f"""
        select count(*) as documents, count(*) filter (len(phrases) > 0) as flagged,
        count(*) filter (len(phrases) = 0) as retained from ({_ANNOTATED})""",
    "retained_rows": f"select doc_id, n_chars from ({_ANNOTATED}) where len(phrases) = 0",
    "phrase_scan": _hits(),
    "phrase_summary": f"""
        select phrase, count(*) as matches, max(severity) as severity from ({_hits()}) group by phrase""",
    "blocklist_filter": f"select doc_id, {_contains_any(PHRASES, 'lower(text)')} as blocked from documents",
    "banned_word_filter": f"""
        select source_rank, seq, length(text) as characters from ({_SOURCES[0]} union all {_SOURCES[1]})
        where not {_contains_any(BANNED, "lower(text)")}""",
    "redact_phrases": f"select doc_id, {_redacted()} as text from documents",
    "record_text_keys": """
        with lines as (select conv_id, turn, case turn % 4
            when 0 then json_object('text', text, 'role', role)
            when 1 then json_object('prompt', text, 'turn', turn)
            when 2 then json_object('text', '', 'prompt', 0, 'content', text)
            else json_object('role', role, 'turn', turn, 'gap', ' ', 'body', text) end as j from conversations),
        keyed as (select *, coalesce(nullif(json_extract_string(j, '$.text'), ''),
            json_extract_string(j, '$.content'), json_extract_string(j, '$.prompt')) as keyed from lines)
        select conv_id, turn, coalesce(keyed, json_extract_string(j, '$.role')) as first_text,
            coalesce(keyed, json_extract_string(j, '$.role') || ' ' || json_extract_string(j, '$.body')) as joined_text
        from keyed""",
    "row_as_json": """
        select conv_id, turn, cast(json_object('conv_id', conv_id, 'turn', turn, 'role', role, 'body', text)
        as varchar) as text from conversations""",
    "instruction_prefix": f"select conv_id, turn, concat({literal(INSTRUCTION)}, text) as text from conversations",
    "cells_joined": """
        select c_custkey, concat_ws(' | ', c_name, case when c_nationkey % 3 = 0 then null else c_mktsegment end,
        cast(c_nationkey as varchar)) as text from customer""",
    "ndjson_concat": """
        with lines as (select conv_id, turn, list_concat(list_transform(string_split(text, ' '),
            lambda w: cast(json_object('response', w || ' ') as varchar)),
            ['', '{"response": 5}', '{"response": "lost']) as ls from conversations)
        select conv_id, turn, array_to_string(list_transform(list_filter(ls, lambda l: json_valid(l)
            and json_type(case when json_valid(l) then l end, '$.response') = 'VARCHAR'),
            lambda l: json_extract_string(l, '$.response')), '') as answer from lines""",
    "name_rules": """
        select doc_id, source || '_' || f as safe, case lang when 'en' then 'datasets' when 'es' then 'spaces'
        else 'models' end || '--' || source || '--' || f as cache, case lang when 'en' then 'meta-llama'
        when 'de' then 'qwen' when 'fr' then 'dolphin' else 'generic' end as family
        from (select *, case lang when 'en' then 'Llama-2' when 'de' then 'Qwen' when 'fr' then 'dphn_x'
        else 'Other' end as f from documents)""",
    "source_head_n": f"""
        select doc_id, source, text from documents
        qualify row_number() over (partition by source order by doc_id) <= {HEAD}""",
    "mix_capped": f"""
        with mixed as ({" union all ".join(
            f"select * from ({s} qualify row_number() over (order by seq) <= {MAX_PER_SOURCE})" for s in _SOURCES)}),
        keyed as (select *, md5('42|' || source_rank || '|' || seq) as shuffle_key from mixed)
        select seq, text, source_rank, shuffle_key from keyed
        qualify row_number() over (order by shuffle_key) <= {MAX_PER_SOURCE * len(_SOURCES)}""",
    "concat_sources": f"""
        {_SOURCES[0]} union all by name {_SOURCES[1]} union all by name
        select page_id as seq, url, 2 as source_rank from pages""",
    "quick_subset": f"select doc_id, text from documents order by doc_id limit {QUICK_ROWS}",
    "shuffled_order": """
        select row_number() over (order by md5('42|' || doc_id)) - 1 as place, doc_id,
        md5('42|' || doc_id) as shuffle_key from documents""",
    "train_test_split": f"""
        select doc_id, {_split("'42|' || doc_id", "documents")} as split from documents""",
    "train_test_buckets": """
        select doc_id, case when cast('0x' || left(md5('42|' || doc_id), 8) as bigint) < 429496729
        then 'test' else 'train' end as split from documents""",
    "vocab_topn": _vocabulary("documents"),
    "token_arrays": f"""
        with {_coded("documents", "doc_id", 512)} select doc_id, {_shown(_padded(512))} as input_ids,
        {_shown(_mask(512))} as attention_mask,
        {_shown(f"list_transform({_padded(512)}, lambda t: case when t = 0 then -100 else t end)")} as labels
        from coded""",
    "training_set": f"""
        {_TRAINING} select source_rank, seq, split, {_shown(_padded(260))} as input_ids,
        {_shown(_padded(260))} as labels from marked""",
    "training_set_stats": f"""
        {_TRAINING} select split, count(*) as examples, cast(sum(len(ids)) as bigint) as tokens
        from marked group by split""",
    "classification_set": f"""
        with rows as (select doc_id as seq, text, quality from documents join labels using (doc_id)),
        {_coded("rows", "seq", 128)}
        select seq, quality as labels, {_split("'42|0|' || seq", "rows")} as split,
        {_shown(_padded(128))} as input_ids, {_shown(_mask(128))} as attention_mask from coded""",
    "vector_distance": """
        select a.vec_id, round(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i:
        (a.embedding[i]::double - b.embedding[i]::double) * (a.embedding[i]::double - b.embedding[i]::double))), 6)
        as d2 from embeddings a join embeddings b on b.vec_id = a.vec_id + 1""",
    "knn_top5": _KNN,
    "knn_blocks": _KNN,
    "committed_dataset": """
        select doc_id, md5(text) as text_md5, (select count(*) from documents) as n, false as damaged from documents""",
    "rag_prompts": f"""
        with embedded as (select e.* from embeddings e join documents on doc_id = vec_id),
        near as ({_RANKED.replace("from embeddings q, embeddings d", "from embedded q, embedded d")}),
        contexts as (select query_id, string_agg(text, chr(10) order by rank) as context
            from near join documents using (doc_id) group by query_id)
        select query_id, context, concat('Answer the question using the context below:', chr(10), chr(10),
            context, chr(10), chr(10), 'Question: What does ', source, ' say in ', lang, '?') as prompt
        from contexts join documents on doc_id = query_id""",
    "validation_report": """
        select 'size' as "check", count(*) >= 5000000000 as ok,
        count(*) || ' rows, but at least 5000000000 are wanted' as message from documents
        union all select 'columns', false, 'no column summary'""",
    "dataset_metadata": "select count(*) as length, 'doc_id text lang source n_chars' as columns from documents",
    "estimated_length": "select least(count(*), 1000) as length, count(*) <= 1000 as exact from events",
    "latest_by_kind": f"""
        select event_type as kind, max_by(event_id, (ts, event_id)) as path,
        {_STAMP.replace("ts", "max(ts)", 1)} as created_at from events group by event_type""",
    "preferred_dataset": """
        select 'sanitized' as kind, '/data/sanitized_dataset_' || max_by(event_id, ts) as path
        from events where event_type = 'purchase' having count(*) > 0
        union all select 'custom', '/data/custom_dataset_' || max_by(event_id, ts) from events
        where event_type = 'click' having count(*) > 0
        and not exists (select 1 from events where event_type = 'purchase')""",
    "status_summary": f"select {_STATUS} as status, count(*) as items from events group by 1",
    "failed_items": f"select event_id, user_id from events where {_STATUS} = 'failed'",
    "run_log_rows": f"""
        select 'run' || user_id as run_id, {_STAMP} as "timestamp",
        case event_type when 'error' then 'ERROR' else 'INFO' end as level, 'loader' as component,
        event_type as message, case when event_type = 'view' then ''
        else cast(json_object('detail', props, 'user', user_id) as varchar) end as context from events""",
    "entry_sizes": f"""
        select root, category, entry, cast(sum(length) as bigint) as size_bytes from ({_VISIBLE}) group by all""",
    "size_rollup": f"""
        select category, entry, cast(sum(length) as bigint) as size_bytes from ({_VISIBLE})
        group by rollup (category, entry)""",
    "move_plan": f"""
        with files as ({_FILES}), taken as (select distinct {_FOLDER} || '/' || entry as destination from files
            where leaf like '%.html'),
        items as (select root || '/' || entry as source, {_FOLDER} || '/' || entry as destination,
            cast(sum(length) as bigint) as size_bytes, category from files where entry not like '.%'
            group by root, category, entry)
        select source, destination, size_bytes, category, case when destination in (select destination from taken)
        then 'skip-conflict' else 'move' end as action from items""",
    "format_flags": f"""
        select {_HOST} as root, bool_or(url like '%.html') as gguf, false as ggml,
        bool_or(url like '%#top') as safetensors,
        bool_or(url like '%utm_source%' and url not like '%.html' and url not like '%#top') as gptq
        from pages group by 1""",
    "snapshot_state": f"""
        with pages2 as (select {_HOST} as repo, case ({_PARTS})[2] when 'en' then 'snapshots' when 'fr' then 'refs'
            else 'downloads' end as area, url like '%utm_source%' or url like '%#top' as marked from pages),
        hosts as (select repo, bool_or(area = 'snapshots') as present, bool_or(area = 'refs') as refs,
            count(*) filter (marked and area <> 'refs') as markers from pages2 group by repo)
        select repo, case when not present then 'missing' when markers > 0 or not refs then 'incomplete'
        else 'complete' end as state, case when present then markers else 0 end as markers from hosts""",
    "csv_text_column": f"select {_strip('text')} as text from conversations where length({_strip('text')}) > 0",
    "csv_joined_cells": """
        select c_custkey || ' | ' || c_name || ' | ' || c_nationkey || ' | ' || c_mktsegment as text from customer""",
    "tfidf_neighbours": f"""
        with texts as (select 'd' as side, doc_id as id, text from documents union all
            select 'q', item_id, text from benchmark),
        hits as (select side, id, cast('0x' || left(md5(w), 8) as bigint) % 256 as b, count(*) as n
            from (select side, id, unnest({_WORDS}) as w from texts) group by all),
        total as (select count(*) as n from documents),
        weights as (select b, ln(((select n from total) + 1) / (coalesce(df, 0) + 1)) as idf
            from range(256) r(b) left join (select b, count(*) as df from hits where side = 'd' group by b) using (b)),
        dense as (select t.side, t.id, list(coalesce(n, 0) * idf order by weights.b) as v
            from texts t cross join weights left join hits on hits.side = t.side and hits.id = t.id and hits.b = weights.b
            group by t.side, t.id),
        lengths as (select *, sqrt(list_sum(list_transform(v, lambda x: x * x))) as size from dense),
        unit as (select side, id, list_transform(v, lambda x: cast(case when size > 0 then x / size else 0 end as float))
            as v from lengths),
        pairs as (select q.id as query_id, d.id as doc_id, list_sum(list_transform(range(1, 257), lambda i:
            (q.v[i]::double - d.v[i]::double) * (q.v[i]::double - d.v[i]::double))) as d2
            from unit q, unit d where q.side = 'q' and d.side = 'd'),
        ranked as (select *, row_number() over (partition by query_id order by d2, doc_id) as rank from pairs)
        select query_id, doc_id, round(d2, 6) as d2, cast(rank as integer) as rank from ranked where rank <= 5""",
    "csv_headerless": "select s_suppkey || ' | ' || s_name || ', Ltd | ' || s_nationkey as text from supplier",
    "text_folder": f"select {_strip('html')} as text from pages where length({_strip('html')}) > 0",
    "mixed_folder": f"""
        with files as (select {_strip("replace(text, ' ', ', ')")} as text from documents
            union all select {_strip("string_agg(text, chr(10) order by item_id)")} from benchmark),
        firsts as (select distinct text from files where length(text) > 0)
        select text, 1 as documents from firsts union all select 'metadata', count(*) from firsts""",
    "clean_copy": f"""
        select 'row' as kind, doc_id as a, length(text) as b from ({_ANNOTATED}) where len(phrases) = 0
        union all select 'metadata', count(*) filter (len(phrases) > 0), count(*) filter (len(phrases) = 0)
        from ({_ANNOTATED})""",
    "word_lists": """
        with words as (select item_id % 3 as kind,
            array_to_string(string_split(regexp_replace(text, '\\s+', ' ', 'g'), ' ')[1:3], ' ') as w from benchmark),
        lines as (select kind, trim(case kind when 2 then w else '# ' || w end) as w from words)
        select 'none' as mode, w as word from lines union all
        select 'raw', lower(w) from lines where kind <> 0 union all
        select 'stripped', w from lines where kind = 2""",
    "redact_single_pass": f"""
        select doc_id, regexp_replace(text, {literal("|".join(sorted(REDACTED, key=len, reverse=True)))}, '[REDACTED]', 'gi')
        as text from documents""",
    "vector_store": """
        select doc_id, text, len(embedding) as dimensions,
        round(list_sum(list_transform(embedding, lambda x: x::double)), 6) as total
        from documents join embeddings on doc_id = vec_id""",
    "jsonl_round_trip": "select text from conversations where text <> ''",
    "line_source": f"""
        select text from (select {_strip("unnest(string_split(text, chr(10)))")} as text from benchmark)
        where length(text) > 0""",
    "corpus_report": f"""
        with firsts as (select min(doc_id) as doc_id from documents group by {_strip("text")}),
        numbered as (select doc_id, row_number() over (order by doc_id) - 1 as index from firsts)
        select index, array_to_string(phrases, '|') as matched_phrases, {_EXCERPT} as excerpt
        from ({_ANNOTATED}) join numbered using (doc_id) where len(phrases) > 0""",
    "phrase_table_places": _LISTED_PLACES,
    "phrase_table_counts": f"""
        select phrase, count(*) as places, count(distinct doc_id) as documents from ({_LISTED_PLACES}) group by phrase""",
    "manifest_sources": """
        select cast(rank as int) as source_rank, name, number, md5(text) as text_md5 from (
            select 0 as rank, 'documents' as name, doc_id as number, text from documents union all
            select 1, 'conversations', conv_id, text from conversations where turn = 0 union all
            select 2, 'benchmark', item_id, text from benchmark)""",
    "prepared_mixture": f"""
        {" union all ".join(f"select text from (select * from {t} limit {MAX_PER_SOURCE})"
                            for t in ("documents", "conversations", "benchmark"))}""",
    "stream_flagged": f"""
        select doc_id as index, array_to_string(phrases, '|') as matched_phrases, {_EXCERPT} as excerpt
        from ({_ANNOTATED}) where len(phrases) > 0""",
    "stream_distinct": f"""
        with came as (select md5(text) as text_md5, doc_id % 4 as delivery, doc_id % 8 = 7 as late from documents),
        first as (select distinct text_md5, {DELIVERIES[0]} as day from came where delivery = 0),
        second as (select distinct text_md5, {DELIVERIES[1]} from came where delivery = 1
            and text_md5 not in (select text_md5 from first)),
        third as (select distinct text_md5, {DELIVERIES[2]} from came where delivery = 2
            and text_md5 not in (select text_md5 from first union all select text_md5 from second)),
        fourth as (select distinct text_md5, {DELIVERIES[3]} from came where delivery = 3 and not late
            and text_md5 not in (select text_md5 from third))
        select text_md5, cast(day as bigint) as day from
        (select * from first union all select * from second union all select * from third union all select * from fourth)""",
    "banned_long_list": f"""
        with words as (select distinct unnest(regexp_split_to_array(lower(text), '[^a-z]+')) as word from benchmark),
        long as (select word from words where length(word) >= {BANNED_LETTERS})
        select doc_id, n_chars from documents d where not exists (select 1 from long where contains(lower(d.text), word))""",
}

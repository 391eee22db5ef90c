"""The queries of this subpackage, with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

import corpus_pipeline

from . import bpe, html, jaccard, katz, language, leaks, quality, secrets, simhash, spelling, substring, suffix, whitening

QUERIES = {
    "op1_html_extraction": html.op1_html_extraction,
    "op2_suffix_array_dedup": suffix.op2_suffix_array_dedup,
    "op3_ngram_jaccard_join": jaccard.op3_ngram_jaccard_join,
    "op4_quality_rules": quality.op4_quality_rules,
    "op5_language_id": language.op5_language_id,
    "op6_substring_dedup": substring.op6_substring_dedup,
    "op7_lm_scoring": katz.op7_lm_scoring,
    "op8_byte_bpe": bpe.op8_byte_bpe,
    "op9_benchmark_decontamination": leaks.op9_benchmark_decontamination,
    "op10_secret_scans": secrets.op10_secret_scans,
    "op11_spelling_variants": spelling.op11_spelling_variants,
    "op12_simhash_near_dedup": simhash.op12_simhash_near_dedup,
    "op13_embedding_whitening": whitening.op13_embedding_whitening,
    "pipeline": corpus_pipeline.run,
}

WORDS = r"list_filter(string_split_regex({text}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"



def _crc(i: int) -> int:
    """What a byte does to a CRC-32."""
    for _ in range(8):
        i = (i >> 1) ^ (0xEDB88320 if i & 1 else 0)
    return i


CRCS = [_crc(i) for i in range(256)]

ORACLES: dict[str, str] = {
    "op11_spelling_variants": f"""with recursive runs as (select doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\\x{{C0}}-\\x{{FF}}]+')) as run from documents where text is not null),
 g as (select doc_id, run, count(*) as k, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as h from runs where length(run) >= 7 group by 1, 2),
 c as (select run, k, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::bigint)), lambda crc, b: xor(crc >> 8, {CRCS}[xor(crc & 255, b) + 1])), 4294967295::bigint) as crc from g),
 t as (select case when crc % 31 = 0 then substr(run, 1, crc % length(run)) || substr(run, crc % length(run) + 2) else run end as word, k from c),
 v as (select word, cast(sum(k) as bigint) as n from t where length(word) >= 7 group by 1 having sum(k) >= 2),
 cut as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as part from (select word, n, unnest(range(1, length(word) + 1)) as i from v)),
 near as (select a.word, b.word as other, b.n as m from cut a join cut b on a.part = b.part and a.i = b.i and a.word <> b.word union select c.word, v.word, v.n from cut c join v on v.word = c.part union select v.word, c.word, c.n from cut c join v on v.word = c.part),
 best as (select word, count(*) as n_near, first(other order by m desc, other) as other, max(m) as m from near group by 1),
 f as (select v.word, v.n, coalesce(n_near, 0) as n_near, case when m >= 10 * n then other end as form, case when m >= 10 * n then m end as form_n from v left join best using (word)),
 r as (select word, word as spot, 0 as d from f union all select r.word, f.form, d + 1 from r join f on f.word = r.spot where f.form is not null)
 select word, form, (select max_by(spot, d) from r where r.word = f.word) as root, n, n_near, form_n from f""",
    "op3_ngram_jaccard_join": f"""with recursive w as (select doc_id, {WORDS.format(text="translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} as ws from documents),
 s as (select doc_id, case when len(ws) = 0 then [] when len(ws) < 5 then [array_to_string(ws, ' ')] else list_distinct(list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))) end as s from w),
 g as (select doc_id, unnest(s) as g from s), o as (select a.doc_id as x, b.doc_id as y, count(*) as o from g a join g b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
 l as (select x, y from o join s a on a.doc_id = x join s b on b.doc_id = y where 100 * o >= 75 * (len(a.s) + len(b.s) - o)), e as (select x, y from l union all select y, x from l),
 r as (select doc_id, doc_id as root from s union select e.y, r.root from r join e on e.x = r.doc_id) select s.doc_id, cast(len(s.s) as bigint) as n_shingles, min(r.root) as component_id from s join r using (doc_id) group by 1, 2""",
}

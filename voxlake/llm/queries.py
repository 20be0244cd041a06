"""The queries of the operators: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import base, chat, divergence, fingerprint, langid, line_quality, merkle, mixing, ngram_join, sharding, sp_bpe, suffix_dedup, token_counts, toxicity

#: A conversation whose texts hold control strings of a chat template.
SPOILT = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def tokenizer_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 40 shards by LPT over groups of equal texts."""
    return sharding.shard_documents(base.read(spark, sf_dir, "documents"), 40)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likenesses."""
    return fingerprint.fingerprint_documents(base.read(spark, sf_dir, "documents"))


def op3_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document with the size of its set of five-word shingles and its component of links of 0.8 or more."""
    return ngram_join.jaccard_components(base.read(spark, sf_dir, "documents"), percent=80, n=5)


def op4_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's ids and what they decode to, as digests."""
    base.bounded_batches(spark)
    return sp_bpe.encode_documents(base.read(spark, sf_dir, "documents"), tokenizer_path())


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the bytes of strings of 200 that start twice."""
    return suffix_dedup.dedup_documents(base.read(spark, sf_dir, "documents"))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base figures of each document and the verdict of line frequencies per source."""
    return line_quality.line_rules(base.read(spark, sf_dir, "documents"))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's language by centroids fitted on the rows that are not held out."""
    docs = base.read(spark, sf_dir, "documents")
    return langid.predict_languages(docs, langid.fit_languages(docs.where(~langid.held_out("doc_id"))))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix of all sources takes of each document, and the slots of the schedule in which it stands."""
    return mixing.mix_documents(base.read(spark, sf_dir, "documents"))


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation, formatted and read back, with one whose texts hold control strings."""
    rows = base.read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    spoilt = spark.sql(" union all ".join(f"select {c}L as conv_id, {t}L as turn, '{r}' as role, '{x}' as text" for c, t, r, x in SPOILT))
    return chat.format_conversations(rows.unionByName(spoilt))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's score by a model fitted on labels of the rows that are not held out."""
    docs = base.read(spark, sf_dir, "documents")
    model = toxicity.fit_toxicity(docs, base.read(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs.withColumn("held_out", langid.held_out("doc_id")), model, ("doc_id", "held_out"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ from one another, and the terms in which each differs from its language."""
    return divergence.audit(base.read(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's number of byte-level tokens, and whether they are more than 1024."""
    return token_counts.count_tokens(base.read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's leaf, roots and proof, and what its proof makes of the document if its text was tampered with."""
    return merkle.manifest(base.read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sharding": op1_sharding,
    "op2_fingerprints": op2_fingerprints,
    "op3_ngram_join": op3_ngram_join,
    "op4_sentencepiece": op4_sentencepiece,
    "op5_suffix_dedup": op5_suffix_dedup,
    "op6_quality_rules": op6_quality_rules,
    "op7_language_id": op7_language_id,
    "op8_mixing": op8_mixing,
    "op9_chat_formatting": op9_chat_formatting,
    "op10_toxicity": op10_toxicity,
    "op11_divergence": op11_divergence,
    "op12_token_counts": op12_token_counts,
    "op13_merkle": op13_merkle,
}


def _escaped_sql(column: str) -> str:
    """The SQL of chat.escape."""
    out = f"replace(coalesce({column}, ''), '\\', '\\\\')"
    for c in chat.CONTROL:
        out = f"replace({out}, '{c}', '{c[0]}\\{c[1:]}')"
    return out


#: Shingles as texts, pairs that share one, and what is reached over links.
JOIN_SQL = """with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') as w from documents),
s as (select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) end) as g from w),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by a.doc_id, b.doc_id),
l as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
r(a, b) as (select distinct a, a from l union select r.a, l.b from r join l on r.b = l.a),
c as (select a, min(b) as b from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(c.b, d.doc_id) as component_id from documents d left join n on n.doc_id = d.doc_id left join c on c.a = d.doc_id"""

#: Base figures by windows over words and lines; lines in more than 50 and 1 % of a host's distinct texts are taken out.
RULES_SQL = """with w as (select doc_id, source as host, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as w from documents),
t as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from (select doc_id, w, unnest(range(1, len(w) - 1)) as i from w)),
again as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, g) as n from t) where n > 1),
repeated as (select doc_id, count(distinct i + j) as n from again, (select unnest([0, 1, 2]) as j) x group by doc_id),
l as (select doc_id, host, text, unnest(string_split(text, chr(10))) as line from w),
e as (select doc_id, host, text, line, regexp_extract_all(line, '[^\\x20\\x09-\\x0D]+') as lw from l),
dup as (select doc_id, count(*) - count(distinct line) as n from e where len(lw) > 0 group by doc_id),
norm as (select doc_id, host, text, regexp_replace(lower(array_to_string(lw, ' ')), '[0-9]', '0', 'g') as line, len(lw) as k from e where len(lw) > 0),
hosts as (select host, count(distinct text) as n from w group by host),
over as (select c.host, line from (select host, line, count(distinct text) as n from norm group by host, line) c join hosts h on h.host is not distinct from c.host where c.n > greatest(50, h.n * 0.01)),
gone as (select doc_id, sum(k) as n from norm join over on over.line = norm.line and over.host is not distinct from norm.host group by doc_id),
f as (select w.doc_id, len(w) as n_words, length(regexp_replace(w.text, '[\\x20\\x09-\\x0D]+', '', 'g')) as word_chars, length(w.text) - length(regexp_replace(w.text, '[#*$%&|<>]', '', 'g')) as n_symbols,
 coalesce(dup.n, 0) as n_dup_lines, coalesce(repeated.n, 0) as n_repeat_words, coalesce(gone.n, 0) as gone from w left join dup on dup.doc_id = w.doc_id left join repeated on repeated.doc_id = w.doc_id left join gone on gone.doc_id = w.doc_id)
select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words,
 n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed, not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and n_words - gone >= 0.5 * n_words as kept, cast(gone as bigint) as n_line_words_removed from f"""


def _crc_sql(column: str) -> str:
    """CRC-32 of the bytes of a text: each byte moves the register by the steps of its eight bits, which add up."""
    steps = []
    for bit in range(8):
        c = 1 << bit
        for _ in range(8):
            c = (c >> 1) ^ (0xEDB88320 if c & 1 else 0)
        steps.append(f"(xor(c, b) >> {bit} & 1) * {c}")
    move = "c >> 8"
    for step in steps:
        move = f"xor({move}, {step})"
    data = f"list_transform(regexp_extract_all(hex(encode({column})), '..'), lambda h: cast('0x' || h as bigint))"
    return f"xor(list_reduce({data}, lambda c, b: {move}, cast(4294967295 as bigint)), 4294967295)"


def _uniform_order(column: str) -> str:
    """The order of base.uniform, whose 64 bits are signed."""
    return f"md5({column}) < '8', substr(md5({column}), 1, 16)"


#: A recursion gives the groups, largest first, to the least load; groups of one size then take these shards by their hash.
SHARD_SQL = f"""with recursive d as materialized (select doc_id, coalesce(text, '') as text, cast(strlen(coalesce(text, '')) + 16 as bigint) as size, md5(coalesce(text, '')) as g from documents),
g as materialized (select g, cast(sum(size) as bigint) as size, {_uniform_order("upper(g)").replace(", substr", " as sign, substr")} as h from d group by g),
k as materialized (select g, size, row_number() over (order by size desc, sign, h, g) as k, row_number() over (partition by size order by sign, h, g) as r from g),
lpt as (select cast(0 as bigint) as k, cast(0 as bigint) as size, 0 as shard, list_transform(range(40), lambda x: cast(0 as bigint)) as loads
 union all select k.k, k.size, list_position(loads, list_min(loads)) - 1, list_transform(loads, lambda x, i: case when i = list_position(loads, list_min(loads)) then x + k.size else x end) from lpt join k on k.k = lpt.k + 1),
p as (select size, shard, row_number() over (partition by size order by shard) as r from lpt where k > 0),
s as (select d.doc_id, d.size, d.text, d.g, p.shard from d join k on k.g = d.g join p on p.size = k.size and p.r = k.r)
select doc_id, size, cast({_crc_sql("text")} as bigint) as text_crc32, 'bytes' as law, cast(shard as integer) as shard,
 row_number() over (partition by shard order by {_uniform_order("coalesce(cast(doc_id as varchar), '')")}, doc_id, g) - 1 as slot, cast(null as integer) as grown_shard from s"""

#: Targets by filling sources in the order of size to weight; a document gives its part of each round of its source's stream that the target
#: takes, cut at the edges of its source's blocks. Block j stands in the j-th slot whose golden-ratio point falls into the source's share.
MIX_SQL = f"""with d as (select row_number() over () as uid, doc_id, source, cast(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) as bigint) as size from documents),
s as (select source, cast(sum(size) as bigint) as n, row_number() over (order by source is null, source) as k, [5, 2, 1][(row_number() over (order by source is null, source) - 1) % 3 + 1] as w from d group by source),
o as (select *, row_number() over (order by n / w, source is null, source) as i from s where n > 0),
f as (select *, 1.5::double * sum(n) over () - 2 * coalesce(sum(n) over (order by i rows between unbounded preceding and 1 preceding), 0) as rest, sum(w) over (order by i rows between current row and unbounded following) as ws from o),
c as (select min(i) as i from f where rest * w / ws <= 2 * n),
free as (select f.i, f.rest, f.ws from f join c on c.i = f.i),
goal as materialized (select s.source, s.k, s.n, case when s.n = 0 then 0.0::double when free.i is null or o.i < free.i then 2.0::double * s.n else free.rest * s.w / free.ws end as target from s left join o on o.source is not distinct from s.source left join free on true),
plan as (select sum(target) as total, cast(greatest(1, least(4096, floor(sum(target) / (500 * count(*))))) as bigint) as block from goal),
ends as (select k, sum(target) over (order by k) / total as hi, coalesce(sum(target) over (order by k rows between unbounded preceding and 1 preceding), 0) / total as lo, k = max(k) filter (where target > 0) over () as last from goal, plan),
points as (select slot, cast((slot + 1)::hugeint * {round(mixing.PHI * 2**64) | 1} % 18446744073709551616::hugeint as double) / 18446744073709551616.0::double as x from (select unnest(range(cast(greatest(1, round_even(total / block, 0)) as bigint))) as slot from plan where total > 0)),
drawn as (select slot, k from points join ends on x >= lo and (x < hi or last)),
slots as materialized (select slot, k from drawn union all select (select count(*) from drawn) + row_number() over (order by k) - 1, k from goal where target > 0 and k not in (select k from drawn)),
ranks as materialized (select slot, k, row_number() over (partition by k order by slot) - 1 as j, count(*) over (partition by k) as m from slots),
a as materialized (select d.uid, d.doc_id, d.size, goal.k, goal.n, goal.target, cast(round_even(goal.target, 0) as bigint) as take,
 cast(coalesce(sum(d.size) over (partition by d.source order by {_uniform_order("concat_ws(':', 1, d.doc_id)")}, d.doc_id, d.size rows between unbounded preceding and 1 preceding), 0) as bigint) as since from d join goal on goal.source is not distinct from d.source),
spans as (select uid, k, take, since + p * n as lo, least(since + p * n + size, take) as hi from (select *, unnest(range((take - 1 - since) // n + 1)) as p from a where size > 0 and since < take)),
edges as (select r.k, r.slot, cast(r.j::hugeint * t.take // r.m as bigint) as lo, cast((r.j + 1)::hugeint * t.take // r.m as bigint) as hi from ranks r join (select distinct k, take from a) t on t.k = r.k),
met as (select uid, slot, least(s.hi, e.hi) - greatest(s.lo, e.lo) as part from spans s join edges e on e.k = s.k and e.lo < s.hi and e.hi > s.lo),
got as (select uid, sum(part) as taken, min(slot) as first_slot, max(slot) as last_slot, count(*) as n_segments from met group by uid)
select doc_id, size, n as source_size, target, cast(coalesce(taken, 0) as bigint) as taken, first_slot, last_slot, coalesce(n_segments, 0) as n_segments from a left join got on got.uid = a.uid"""

#: Every string of 200 bytes (400 hex digits) of every document, those that start twice, and the runs that these cover.
DEDUP_SQL = """with b as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h, cast(strlen(coalesce(text, '')) as bigint) as n from documents),
k as materialized (select doc_id, i, md5(substr(h, 2 * i + 1, 400)) as k from (select doc_id, h, unnest(range(n - 199)) as i from b where n >= 200)),
hit as (select doc_id, i from k where k in (select k from k group by k having count(*) > 1)),
run as (select doc_id, i, sum(case when i <= before + 200 then 0 else 1 end) over (partition by doc_id order by i) as run from (select doc_id, i, lag(i) over (partition by doc_id order by i) as before from hit)),
span as (select doc_id, min(i) as lo, max(i) + 200 as hi from run group by doc_id, run),
gap as (select doc_id, lo, hi, coalesce(lag(hi) over (partition by doc_id order by lo), 0) as since from span),
cut as (select b.doc_id, sum(hi - lo) as removed, count(*) as spans, max(hi) as last, string_agg(substr(h, 2 * since + 1, 2 * (lo - since)), '' order by lo) as kept from gap join b on b.doc_id = gap.doc_id group by b.doc_id)
select b.doc_id, n as n_bytes, cast(coalesce(removed, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans, sha256(unhex(coalesce(kept, '') || substr(h, 2 * coalesce(last, 0) + 1))) as kept_sha256
 from b left join cut on cut.doc_id = b.doc_id"""

#: Every kept term of a language with its count in every source of the language, zeros included, and every pair of sources over these.
DIVERGENCE_SQL = """with d as materialized (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source,
 regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as w from documents),
t as materialized (select r, lang, source, unnest(w) as term from d),
k as materialized (select lang, term from t group by lang, term having count(distinct r) >= 30),
v as (select lang, count(*) as v from k group by lang),
c as materialized (select lang, source, term, count(*) as c from t join k using (lang, term) group by all),
g as materialized (select distinct lang, source from d),
n as (select g.lang, g.source, coalesce(sum(c.c), 0) as n from g left join c on c.lang = g.lang and c.source = g.source group by all),
p as materialized (select n.lang, n.source, k.term, coalesce(c.c, 0) as c, cast(1 + 1000000000::hugeint * (coalesce(c.c, 0) + 5) // (n.n + 5 * v.v) as bigint) as p
 from n join k on k.lang = n.lang join v on v.lang = n.lang left join c on c.lang = n.lang and c.source = n.source and c.term = k.term),
q as (select l.lang, term, cast(1 + 1000000000::hugeint * (c + 5) // (sum(c) over (partition by l.lang) + 5 * v.v) as bigint) as q from (select lang, term, sum(c) as c from c group by all) l join v on v.lang = l.lang),
pv as (select a.lang, a.source, b.source as item, sum(abs(a.p - b.p)) as value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
o as (select a.lang, a.source, 'pair' as part, b.source as item, cast(coalesce(pv.value, 0) as bigint) as value from g a join g b on a.lang = b.lang and a.source <> b.source left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source
 union all select p.lang, p.source, 'term', p.term, p.p - q.q from p join q on q.lang = p.lang and q.term = p.term where p.c > 0 and p.p > q.q),
x as (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from o)
select * from x where part = 'pair' or rank <= 50"""


def _field_sql(column: str) -> str:
    return f"case when {column} is null then '-' else strlen(cast({column} as varchar)) || ':' || {column} end"


def _levels_sql(name: str, n: int, keep: str) -> str:
    """n levels over <name>_m0 (key, i, n, h) and <name>_p0 (keep, key, i, n, altered, proof): the nodes above, and what each leaf folds to."""
    out = ""
    for k in range(n):
        at = "64 * (p.i % 16)"
        left, right = f"substr(r.run, 1, {at})", f"substr(r.run, {at} + 65)"
        out += f"""{name}_r{k} as materialized (select key, i // 16 as i, any_value((n + 15) // 16) as n, string_agg(h, '' order by i) as run from {name}_m{k} where n > 1 group by key, i // 16),
{name}_m{k + 1} as materialized (select key, i, n, h from {name}_m{k} where n = 1 union all select key, i, n, sha256(run) from {name}_r{k}),
{name}_p{k + 1} as materialized (select {keep}, p.key, p.i // 16 as i, (p.n + 15) // 16 as n, case when p.n > 1 then sha256({left} || altered || {right}) else altered end as altered,
 case when p.n > 1 then proof || {left} || {right} else proof end as proof from {name}_p{k} p left join {name}_r{k} r on r.key = p.key and r.i = p.i // 16 and p.n > 1),
"""
    return out


def _merkle_sql(levels: int = 6, top: int = 4) -> str:
    """Level by level, for at most 16 ** levels rows of a source and 16 ** top sources."""
    leaf = lambda text: "sha256(" + " || ".join(_field_sql(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = _crc_sql("cast(doc_id as varchar)")
    low = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with l as materialized (select row_number() over () as id, doc_id, source, {_field_sql("source")} as key, {leaf("text")} as h, case when doc_id is not null and {crc} % 5 = 0 then {leaf("low")} end as low_h from (select *, {low} as low from documents)),
o as materialized (select *, row_number() over (partition by key order by doc_id nulls first, h) - 1 as i, count(*) over (partition by key) as n from l),
d_m0 as (select key, i, n, h from o), d_p0 as (select id, key, i, n, coalesce(low_h, h) as altered, '' as proof from o),
{_levels_sql("d", levels, "id")}
s as materialized (select m.key, m.h, row_number() over (order by x.source nulls first) - 1 as i, count(*) over () as n from d_m{levels} m join (select distinct key, source from l) x on x.key = m.key),
t_m0 as (select '' as key, i, n, h from s), t_p0 as (select p.id, p.key as tree, '' as key, s.i, s.n, p.altered, p.proof from d_p{levels} p join s on s.key = p.key),
{_levels_sql("t", top, "id, tree")}
root as (select h from t_m{top})
select l.doc_id, l.h as leaf, s.h as subroot, root.h as root, sha256(p.proof) as proof_sha256, p.altered as folded_root, p.altered = root.h as verified from t_p{top} p join l on l.id = p.id join s on s.key = p.tree, root"""


#: The other operators have no SQL form that runs on whole tables; tests hold them against brute force or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op1_sharding": SHARD_SQL,
    "op3_ngram_join": JOIN_SQL,
    "op5_suffix_dedup": DEDUP_SQL,
    "op6_quality_rules": RULES_SQL,
    "op8_mixing": MIX_SQL,
    "op11_divergence": DIVERGENCE_SQL,
    "op13_merkle": _merkle_sql(),
    "op9_chat_formatting": "with c as (select conv_id, turn, role, text from conversations union all select * from (values "
    + ", ".join(f"({c}, {t}, '{r}', '{x}')" for c, t, r, x in SPOILT)
    + f""") v)
select conv_id, count(*) as n_turns, sha256(string_agg(coalesce(role, '') || chr(10) || coalesce(text, '') || chr(10), '' order by turn, role, text)) as turns_sha256,
 cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
 sha256(coalesce(string_agg(coalesce(text, ''), '' order by turn, role, text) filter (where role = 'assistant'), '')) as loss_sha256,
 cast(sum({len(chat.TURN) + len(chat.SAYS) + len(chat.END)} + length({_escaped_sql("role")}) + length({_escaped_sql("text")})) as bigint) as formatted_chars
 from c group by conv_id"""
}

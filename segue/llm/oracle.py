"""The queries SQL can express, written from their contracts.

Left out: op2, op4 and op9 (chains, trained trees, approximate search), op3 and op8
(tokenizers), op5 and op7 (SQL would hold every shingle or 200-byte string of the corpus at
once), op11 (its hash).  Those are tested against brute force, libraries and round trips in tests/llm.
"""

from __future__ import annotations

from . import chat, quality, secrets

_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
with said as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all select -7, 0, 'user', '\### Assistant: </turn> ok'
  union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
counted as (
  select *, (length(text) - length(replace(text, '{chat.TURN_END}', ''))) // {len(chat.TURN_END)} as ends,
         (length(text) - length(replace(text, '{chat.HEADER}', ''))) // {len(chat.HEADER)} as heads,
         length(role) - length(regexp_replace(role, '[\\:<#]', '', 'g')) as coded
  from said)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = '{chat.LOSS_ROLE}'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn, role, text) filter (role = '{chat.LOSS_ROLE}'), '')) as loss_sha256,
       sum({len(chat.HEADER) + 2 + len(chat.TURN_END) + 2} + length(role) + coded + length(text) + ends + heads)::bigint as formatted_chars
from counted group by conv_id"""

_OP6 = rf"""
with texts as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
split as (
  select *, regexp_extract_all(text, '{_WORD}') as words,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) as lines from texts),
windows as (
  select row, i, count(*) over (partition by row, run) as times from (
    select row, i, array_to_string(words[i + 1 : i + {quality.WINDOW}], ' ') as run from (
      select row, words, unnest(range(len(words) - {quality.WINDOW - 1})) as i from split where len(words) >= {quality.WINDOW}))),
repeated as (
  select row, count(distinct i + j) as n from windows, (select unnest(range({quality.WINDOW})) as j) where times > 1 group by row),
measured as (
  select row, doc_id, text, words, lines, len(words) as n_words, length(array_to_string(words, '')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n, 0) as n_repeat_words
  from split left join repeated using (row))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not (base_failed
            or 4 * n_symbols > n_words
            or 2 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > length(text) - length(regexp_replace(text, '[A-Za-z]', '', 'g'))
            or 5 * len(regexp_extract_all(text, '!+')) > n_words
            or 2 * (length(text) - length(regexp_replace(text, '\p{{L}}', '', 'g'))) < word_chars
            or 4 * len(list_filter(range(1, n_words), lambda i: words[i] = words[i + 1])) > n_words
            or 2 * len(list_distinct(lines)) < len(lines)) as kept
from (select *, n_words < {quality.MIN_WORDS} or 100 * n_repeat_words > {quality.MAX_REPEAT_PERCENT} * n_words as base_failed from measured)"""


def _found(rank: int, rule: secrets.Rule) -> str:
    pattern = rule.pattern.replace("'", "''").replace("(?<![0-9a-f])", "")  # a run begins leftmost anyway
    return f"""
  select row, {rank} as rank, '{rule.kind}' as kind, gap[1] + coalesce(list_sum(list_slice(gap, 2, i)), 0) + coalesce(list_sum(list_slice(size, 1, i - 1)), 0) as start,
         size[i] as size
  from (select row, list_transform(string_split_regex(text, '{pattern}'), lambda x: length(x)) as gap,
               list_transform(regexp_extract_all(text, '{pattern}'), lambda x: length(x)) as size,
               list_transform(regexp_extract_all(text, '{pattern}', {rule.group}), lambda x: length(x)) as weighed,
               unnest(range(1, 1 + len(regexp_extract_all(text, '{pattern}')))) as i
        from texts) where weighed[i] >= {rule.least}"""


_OP10 = f"""
with texts as (select row_number() over () as row, doc_id, coalesce(text, '') as text from documents),
found as ({" union all ".join(_found(i, r) for i, r in enumerate(secrets.RULES))}),
joined as (
  select row, {", ".join(f"count(*) filter (kind = '{r.kind}') as n_{r.kind}" for r in secrets.BASE_RULES)},
         string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, rank) as spans,
         string_agg(kind || ':' || start || ':' || (start + size), ',' order by start, rank) filter (rank < {len(secrets.BASE_RULES)}) as base
  from found group by row)
select doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) as n_{r.kind}" for r in secrets.BASE_RULES)},
       sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans
from texts left join joined using (row)"""


def _tree(name: str, levels: int, leaves: str, proofs: str) -> tuple[list[str], str, str]:
    """Tables of a tree: its levels from (grp, i, d), and the proofs of (row, grp, i, proof, own) through it.

    Each level carries over what is a single node already.  Returns the steps, the table of
    the tops and that of the proofs and folded digests.
    """
    steps = [f"{name}0 as materialized ({leaves})", f"{name}p0 as materialized ({proofs})"]
    for k in range(levels):
        steps.append(f"""{name}r{k} as materialized (
  select grp, i // 16 as i, list(d order by i) as run, any_value(n) as n
  from (select *, count(*) over (partition by grp) as n from {name}{k}) group by grp, i // 16)""")
        steps.append(f"""{name}{k + 1} as materialized (
  select grp, i, case when n > 1 then sha256(array_to_string(run, '')) else run[1] end as d from {name}r{k})""")
        steps.append(f"""{name}p{k + 1} as materialized (
  select p.row, p.grp, p.i // 16 as i,
         p.proof || array_to_string(list_filter(r.run, lambda d, j: j <> p.i % 16 + 1), '') as proof,
         case when n > 1 then sha256(array_to_string(list_transform(r.run, lambda d, j: case when j = p.i % 16 + 1 then p.own else d end), ''))
              else p.own end as own
  from {name}p{k} p join {name}r{k} r on p.grp is not distinct from r.grp and p.i // 16 = r.i)""")
    return steps, f"{name}{levels}", f"{name}p{levels}"


def _leaf(text: str) -> str:
    fields = ["doc_id", "source", "lang", "n_chars", text]
    told = [f"coalesce(strlen(({f})::varchar) || ':' || ({f})::varchar, '-')" for f in fields]
    return f"sha256({' || '.join(told)})"


#: CRC-32 of the decimal digits, byte by byte and bit by bit.
_CRC = """xor(list_reduce(list_transform(string_split(doc_id::varchar, ''), lambda c: ord(c)::bigint),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, bit: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end), 4294967295::bigint), 4294967295)"""
_LOWER = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_below, _subroots, _proofs = _tree(
    "s", 7, "select source as grp, i, leaf as d from placed", "select row, source as grp, i, '' as proof, claimed as own from placed"
)
_above, _root, _checked = _tree(
    "t", 7, f"select '' as grp, i, d from (select d, row_number() over (order by grp nulls first) - 1 as i from {_subroots})",
    f"select row, '' as grp, n.i, proof, own from {_proofs} p join (select grp, row_number() over (order by grp nulls first) - 1 as i from {_subroots}) n on p.grp is not distinct from n.grp",
)
_OP12 = f"""
with leaves as materialized (
  select row_number() over () as row, doc_id, source, {_leaf("text")} as leaf,
         {_leaf(f"case when {_CRC} % 5 = 0 then {_LOWER} else text end")} as claimed from documents),
placed as materialized (
  select *, row_number() over (partition by source order by doc_id nulls first, leaf, row) - 1 as i from leaves),
{", ".join([*_below, *_above])}
select doc_id, leaf, {_subroots}.d as subroot, {_root}.d as root, sha256(proof) as proof_sha256,
       own as folded_root, own = {_root}.d as verified
from leaves join {_checked} using (row) join {_subroots} on source is not distinct from {_subroots}.grp, {_root}"""

_OP13 = """
with valid as materialized (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v
  from embeddings where vec_id is not null and label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
scored as materialized (
  select a.vec_id as anchor_id, r.vec_id as other_id, a.label = r.label as same,
         list_sum(list_transform(list_zip(a.v, r.v), lambda p: p[1] * p[2]))::bigint as score
  from valid a join valid r on a.vec_id % 100 = 0 and a.vec_id <> r.vec_id and len(a.v) = len(r.v)),
positives as (
  select anchor_id, other_id as positive_id, score as positive_score from scored where same
  qualify row_number() over (partition by anchor_id order by score desc, other_id) <= 5)
select anchor_id, positive_id, row_number() over (partition by anchor_id, positive_id order by score desc, other_id)::integer as rank,
       other_id as negative_id, positive_score, score as negative_score
from positives join scored using (anchor_id)
where not same and 30 * positive_score <= 100 * score and 100 * score <= 90 * positive_score
qualify rank <= 10"""

ORACLE: dict[str, str] = {
    "op1_chat_format": _OP1,
    "op6_quality_cascade": _OP6,
    "op10_secret_ledger": _OP10,
    "op12_merkle_manifest": _OP12,
    "op13_hard_negatives": _OP13,
}

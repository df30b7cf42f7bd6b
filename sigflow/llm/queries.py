"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from sigflow.llm.ann import nearest
from sigflow.llm.bpe import bpe_round_trip
from sigflow.llm.chat import damage, repair_conversations
from sigflow.llm.langid import fit_langid, predict_language
from sigflow.llm.lines import dedup_lines
from sigflow.llm.neardup import near_duplicates
from sigflow.llm.packing import best_fit_pack
from sigflow.llm.quality import quality_rules
from sigflow.llm.runs import periodic_runs, plant_periods, strongest
from sigflow.llm.spans import by_suffix_array, remove_repeats
from sigflow.llm.tokens import token_counts
from sigflow.llm.toxicity import fit_toxicity, score_toxicity
from sigflow.session import table

QUERIES = {}
SQL: dict[str, str] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def op7_bpe_round_trip(spark, sf_dir):
    return bpe_round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_best_fit_packing(spark, sf_dir):
    return best_fit_pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@query
def op1_crf_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = predict_language(docs, fit_langid(docs))
    return out.selectExpr("doc_id", "crc32(cast(doc_id as string)) % 3 = 1 as held_out", "lang_pred", "score")


@query
def op2_nb_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    out = score_toxicity(docs, fit_toxicity(docs, table(spark, sf_dir, "labels")))
    return out.selectExpr("doc_id", "crc32(cast(doc_id as string)) % 3 = 1 as held_out", "score", "predicted")


@query
def op3_decision_list(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))[0]


@query
def op4_odd_sketch_dedup(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=4)


SQL["op4_odd_sketch_dedup"] = r"""
with recursive
doc as (select doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') w from documents),
num as (select doc_id, w, coalesce(len(w), 0) n from doc),
sh as (select distinct doc_id, s from (
  select doc_id, unnest(case when n = 0 then [] when n < 4 then [array_to_string(w, ' ')] else list_transform(range(1, n - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) s from num)),
size as (select doc_id, count(*) k from sh group by 1),
pair as (select a.doc_id x, b.doc_id y, count(*) c from sh a join sh b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
link as (select x, y from pair join size p on p.doc_id = x join size q on q.doc_id = y where 100 * c >= 80 * (p.k + q.k - c)),
edge as (select x, y from link union select y, x from link),
reach as (select doc_id x, doc_id y from num union select r.x, e.y from reach r join edge e on e.x = r.y)
select n.doc_id, coalesce(k, 0)::bigint n_shingles, m.c::bigint component_id, n.doc_id = m.c kept
from num n left join size using (doc_id) join (select x, min(y) c from reach group by 1) m on m.x = n.doc_id
"""


def _repeat_sql(length: int) -> str:
    return rf"""
with doc as (select doc_id, coalesce(list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) w from documents),
win as (select doc_id, i, md5(array_to_string(w[i + 1:i + {length}], ' ')) h from (select doc_id, w, unnest(range(0, len(w) - {length - 1})) i from doc)),
rep as (select h from win group by h having count(*) > 1),
gone as (select doc_id, list(distinct i + j) g from (select doc_id, i, unnest(range({length})) j from win where h in (select h from rep)) group by 1),
kept as (select d.doc_id, w, coalesce(g, []) g from doc d left join gone using (doc_id)),
word as (select doc_id, len(w) n, len(g) r, w, g from kept),
stay as (select doc_id, list(x order by i) k from (select doc_id, unnest(w) x, unnest(range(len(w))) i from word) s where not exists (select 1 from (select doc_id d, unnest(g) p from word) q where q.d = s.doc_id and q.p = s.i) group by 1)
select doc_id, n::bigint n_words, r::bigint n_removed, sha256(coalesce(array_to_string(k, ' '), '')) kept_sha256 from word left join stay using (doc_id)
"""


@query
def op6_suffix_automata(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), length=35).drop("spans")


@query
def op9_sparse_suffix_arrays(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), length=50, resolver=by_suffix_array).drop("spans")


SQL["op6_suffix_automata"] = _repeat_sql(35)
SQL["op9_sparse_suffix_arrays"] = _repeat_sql(50)


@query
def op10_fuzzy_lines(spark, sf_dir):
    return dedup_lines(table(spark, sf_dir, "documents"))


@query
def op5_nn_descent(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"))


@query
def op11_astar_repair(spark, sf_dir):
    return repair_conversations(damage(table(spark, sf_dir, "conversations")), gone="gone")


#: Unsigned crc32 of the ASCII string in {}, bit by bit.
_CRC = "xor(list_reduce(list_prepend(4294967295::bigint, list_transform(string_split({}, ''), lambda c: ord(c)::bigint)), lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"
#: A label is (cost, audit, text so far); the least of a list, by cost and then audit, and null if there is none.
_STEP = "list_min(list_filter([{}], lambda x: x is not null))"


def _label(of: str, cost: str, audit: str, text: str) -> str:
    return f"case when {of} is not null then {{'c': {of}.c + {cost}, 'a': {of}.a || '{audit}', 't': {of}.t || {text}}} end"


def _labels(*options: str) -> str:
    return _STEP.format(", ".join(options))


def _repair_sql() -> str:
    to = {"user": "chr(10) || 'user:'", "assistant": "chr(10) || 'assistant:'"}
    insert_u = _labels("pu", *(_label(f"p{x}", "3", "I", to["user"]) for x in "0sa"))
    insert_a = _labels("pa", _label("pu", "3", "I", to["assistant"]))
    kept, user, assistant = "chr(10) || w.role || ':' || w.txt", "chr(10) || 'user:' || w.txt", "chr(10) || 'assistant:' || w.txt"

    def stays(of: str, initial: str) -> str:
        return f"case when not w.bad and w.r = '{initial}' then {_label(of, 'w.tax', 'K', kept)} end"

    def rerole(of: str, text: str) -> str:
        return f"case when not w.bad then {_label(of, '3 + w.tax', 'R', text)} end"

    step = {
        "p0": _labels(_label("j.p0", "4", "D", "''")),
        "ps": _labels(_label("j.ps", "4", "D", "''"), stays("j.p0", "s")),
        "pu": _labels(_label("j.pu", "4", "D", "''"), *(f(f"j.p{x}", y) for x in "0sa" for f, y in ((stays, "u"), (rerole, user)))),
        "pa": _labels(_label("j.pa", "4", "D", "''"), stays("j.pu", "a"), rerole("j.pu", assistant)),
    }
    hit = _CRC.format("coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ')")
    return rf"""
with recursive
src as (select conv_id, turn, coalesce(role, ' ') role, coalesce(text, ' ') txt, {hit} % 20 k from conversations),
hurt as (
  select conv_id, turn, case when k = 4 then 'user' else role end as role, case when k = 1 then '' when k = 2 then regexp_replace(txt, '[.!?]', '', 'g') else txt end txt, unnest(case when k = 3 then [1, 2] else [1] end) n
  from src where k <> 0),
num as (select *, row_number() over (partition by conv_id order by turn nulls first, role, txt) i from hurt),
flag as (
  select *, role[1] r, not regexp_matches(txt, '[^ 	-]') blank, row_number() over (partition by conv_id, role, txt order by i) > 1 again,
    not regexp_matches(txt, '[.!?][ 	-]*\z') cut, lag(role[1]) over (partition by conv_id order by i) || role[1] pair
  from num),
w as (select *, blank or again bad, case when cut and not blank and not again then 3 else 0 end tax from flag),
walk(conv_id, i, p0, ps, pu, pa) as (
  select distinct conv_id, 0::bigint, {{'c': 0, 'a': '', 't': ''}}, null::struct(c int, a varchar, t varchar), null::struct(c int, a varchar, t varchar), null::struct(c int, a varchar, t varchar) from hurt
  union all
  select j.conv_id, j.i + 1, {step["p0"]}, {step["ps"]}, {step["pu"]}, {step["pa"]}
  from (
    select conv_id, i, p0, ps, {insert_u} pu, pa from (
      select conv_id, i, p0, ps, pu, {insert_a} pa from (
        select conv_id, i, p0, ps, {insert_u} pu, pa from walk))) j
  join w on w.conv_id is not distinct from j.conv_id and w.i = j.i + 1),
last as (select conv_id, max(i) i from walk group by 1),
fin as (select l.conv_id, {_labels("p0", "pa", _label("pu", "3", "I", to["assistant"]), _label("ps", "6", "II", to["user"] + " || " + to["assistant"]))} b from last l join walk x on x.conv_id is not distinct from l.conv_id and x.i = l.i),
sums as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) gaps, count(*) filter (blank) blank, count(*) filter (again and not blank) dup, count(*) filter (tax > 0) cut,
    count(*) filter (pair is not null and pair not in ('su', 'ua', 'au')) illegal
  from w group by 1)
select c.conv_id, coalesce(gaps, 0)::bigint gaps, coalesce(blank, 0)::bigint blank, coalesce(dup, 0)::bigint duplicate, coalesce(cut, 0)::bigint truncated, coalesce(illegal, 0)::bigint illegal,
  coalesce(f.b.c, 0)::bigint as cost, coalesce(f.b.a, '') as audit, sha256(coalesce(f.b.t[2:], '')) repaired_sha256
from (select distinct conv_id from conversations) c left join sums s on s.conv_id is not distinct from c.conv_id left join fin f on f.conv_id is not distinct from c.conv_id
"""


SQL["op11_astar_repair"] = _repair_sql()


@query
def op12_token_counts(spark, sf_dir):
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


@query
def op13_periodic_runs(spark, sf_dir):
    found = periodic_runs(plant_periods(table(spark, sf_dir, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )  # fmt: skip

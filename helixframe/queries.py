"""Registered queries of the engine's own operators, with their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import alphabet, states
from .functions.lineage import local
from .operators import encode, engine, estimate, histories, hmm, lengths, likelihood, rate_relations, rates, shared, simulate, stencils, waits
from .plans import bridge, models
from .plans.bridge import chains, composition, kept, sequences, sites, table
from .plans.models import JointModel
from .sources import forest, newick, tables
from .streaming.forward import forward_stream, log_stream

ETA, TRACT_P, LENGTH = 0.05, 0.3, 0.8
KAPPA, OMEGA, TAU = 2.5, 0.4, 1.5
SEGMENTS = ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]

#: Common parts of the SQL.
SEQ = "seq as (select doc_id, lang, source, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) seq from documents)"
TOK = SEQ + ", sym as (select doc_id, lang, source, unnest(range(length(seq))) pos, unnest(string_split(seq, '')) sym from seq where seq <> ''), tok as (select doc_id, lang, source, cast(pos as int) pos, cast(strpos('ACGT', sym) - 1 as int) st from sym)"
COMP = TOK + ", comp as (select substr('ACGT', st + 1, 1) nt, st, count(*) n, count(*) * 1.0 / sum(count(*)) over () freq from tok group by st)"
HKY = COMP + f""", raw as (select a.st x, b.st y, a.freq px, b.freq * case when abs(a.st - b.st) = 2 then {KAPPA} else 1.0 end r from comp a, comp b where a.st <> b.st),
 hky as (select x, y, r / (select sum(px * r) from raw) q from raw)"""
LSE = "(greatest({a}, {b}) + ln(exp({a} - greatest({a}, {b})) + exp({b} - greatest({a}, {b}))))"


def chain_sql(eta: float, p: float, length: float) -> str:
    ln0 = -2 * eta / p * length
    return f"""c0 as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - 1 site from events),
 c1 as (select user_id, site, site + site // 5 nt_index, -1.0 - strpos('sepvc', substr(event_type, 1, 1)) * 0.25 lnl, strpos('sepvc', substr(event_type, 1, 1)) k from c0),
 c2 as (select user_id, site, lnl, lnl - 0.02 * k * k lnl_no, coalesce(nt_index - lag(nt_index) over (partition by user_id order by site), 1) gap from c1),
 c3 as (select *, lnl_no + {-ln0} e0, lnl + ln(1 - exp(lnl_no - lnl)) - ln(1 - exp({ln0})) e1,
  exp({ln0} * (1 - pow({1 - p}, gap))) eel, exp({ln0}) etl from c2),
 c as (select user_id, site, lnl, e0, e1, ln(eel) p00, ln(1 - eel) p01, ln(etl * (1 - eel) / (1 - etl)) p10, ln(1 - etl * (1 - eel) / (1 - etl)) p11 from c3)"""


def forward_sql(eta: float, p: float, length: float) -> str:
    ln0 = -2 * eta / p * length
    return f"""f as (select user_id, site, e0 + {ln0} a, e1 + ln(1 - exp({ln0})) b from c where site = 0
 union all select c.user_id, c.site, c.e0 + {LSE.format(a='(f.a + c.p00)', b='(f.b + c.p10)')}, c.e1 + {LSE.format(a='(f.a + c.p01)', b='(f.b + c.p11)')}
 from f join c on c.user_id = f.user_id and c.site = f.site + 1)"""


CHAIN, FORWARD = chain_sql(ETA, TRACT_P, LENGTH), forward_sql(ETA, TRACT_P, LENGTH)

_registered: dict[str, tuple[Callable[[SparkSession, str], DataFrame], str | None]] = {}


def query(sql: str | None = None):
    def add(f):
        _registered[f.__name__] = (f, sql)
        return f

    return add


def _r(c, digits: int = 6):
    return F.round(c, digits)


@query(f"with {TOK} select doc_id, pos, st from tok")
def q01_seq_tokens(spark, d):
    return sites(spark, d).select("doc_id", "pos", "st")


@query(f"with {COMP} select nt, n, round(freq, 6) freq, round(ln(freq), 6) log_freq from comp")
def q02_base_composition(spark, d):
    return composition(spark, d).select("nt", "n", _r(F.col("freq")).alias("freq"), _r(F.log("freq")).alias("log_freq"))


@query(f"with {SEQ} select doc_id, cast(k as int) codon_no, substr(seq, cast(k as int) * 3 + 1, 3) codon from (select doc_id, seq, unnest(range(length(seq) // 3)) k from seq where length(seq) % 3 = 0)")
def q03_codon_tokens(spark, d):
    rows = sequences(spark, d).select("doc_id", F.posexplode(alphabet.codons(F.col("seq"))).alias("codon_no", "codon"))
    return rows.select("doc_id", "codon_no", "codon")


@query(f"with {SEQ}, k as (select substr(seq, cast(k as int) * 3 + 1, 3) codon from (select seq, unnest(range(length(seq) // 3)) k from seq where length(seq) % 3 = 0)) select aa, count(*) n from k join (select unnest({list(alphabet.AMINO_ACID)!r}) codon, unnest({list(alphabet.AMINO_ACID.values())!r}) aa) using (codon) group by aa")
def q04_translate_codons(spark, d):
    rows = sequences(spark, d).select(F.explode(alphabet.codons(F.col("seq"))).alias("codon"))
    return rows.select(alphabet.amino_acid(F.col("codon")).alias("aa")).groupBy("aa").agg(F.count(F.lit(1)).alias("n"))


@query(f"with {TOK} select pos % 3 + 1 cs, st, count(*) n from tok group by all")
def q05_codon_position_counts(spark, d):
    obs = sites(spark, d).select(F.col("pos").alias("site"), F.array("st").alias("pattern"))
    return encode.compress(obs).select(F.col("codon_position").alias("cs"), F.get("pattern", F.lit(0)).alias("st"), "n")


@query(f"with {TOK} select 4 * a.st + b.st code, a.st a, b.st b, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all")
def q06_pair_encode_decode(spark, d):
    code = bridge.neighbour_pairs(spark, d).select(alphabet.pair_code(F.col("sa"), F.col("sb")).alias("code"), "n")
    a, b = alphabet.pair_decode(F.col("code"))
    return code.select("code", a.alias("a"), b.alias("b"), "n")


@query(f"with {SEQ} select source, count(distinct length(seq)) lengths, max(length(seq)) longest from seq group by source")
def q07_equal_length_check(spark, d):
    return tables.alignment_lengths(sequences(spark, d), "source")


@query(f"with {TOK} select lang, pos, count(*) n, sum(st) total from tok where pos < 12 group by all")
def q08_site_limit(spark, d):
    named = sequences(spark, d).select(F.col("doc_id").alias("name"), F.col("lang").alias("species"), F.col("source").alias("gene"), "seq")
    rows = encode.site_states(named, n_sites=12)
    return rows.groupBy(F.col("species").alias("lang"), F.col("site").alias("pos")).agg(F.count(F.lit(1)).alias("n"), F.sum("state").alias("total"))


@query("select lang, cast(case when c in ('A', 'C', 'G', 'T', 'a', 'c', 'g', 't') then strpos('ACGT', upper(c)) - 1 else -1 end as int) st, count(*) n from (select lang, unnest(string_split(text, '')) c from documents where length(text) > 0) group by all")
def q09_missing_encoding(spark, d):
    return encode.symbol_states(table(spark, d, "documents"), "lang")


@query("""with n as (select substr('DLNX', cast(p_partkey % 4 as int) + 1, 1) || (p_partkey % 10) || case when p_partkey % 3 = 0 then 'x' else '' end as name from part)
 select case when regexp_full_match(name, 'D[0-9]+') then 'duplication' when regexp_full_match(name, 'L[0-9]+') then 'loss' when regexp_full_match(name, 'N[0-9]+') then 'speciation' else 'tip' end kind, count(*) n from n group by all""")
def q10_node_kind_predicates(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.substring(F.lit("DLNX"), (k % 4 + 1).cast("int"), F.lit(1)), (k % 10).cast("string"), F.when(k % 3 == 0, "x").otherwise(""))
    n = table(spark, d, "part").select(name.alias("name"))
    kind = newick.node_kind_column(F.col("name"))
    return n.groupBy(kind.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(f"with {TOK}, w as (select lang, pos // 3 k, doc_id, string_agg(cast(st as varchar), ',' order by pos) pattern, count(*) c from tok group by all) select lang, pattern, count(*) n from w where c = 3 group by all")
def q11_site_pattern_compression(spark, d):
    obs = sequences(spark, d).select("lang", F.explode(alphabet.triples(F.col("seq"))).alias("pattern"))
    rows = encode.compress(obs, "lang", codon_position=False)
    states = [alphabet.nucleotide_state(F.substring("pattern", k, 1)).cast("string") for k in (1, 2, 3)]
    return rows.select("lang", F.concat_ws(",", *states).alias("pattern"), "n")


@query("select lang, quality, toxic, count(*) n, sum(n_chars) chars from documents join labels using (doc_id) group by all")
def q12_gene_to_orlg_join(spark, d):
    return encode.with_groups(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").groupBy("lang", "quality", "toxic").agg(F.count(F.lit(1)).alias("n"), F.sum("n_chars").alias("chars"))


@query("select c_nationkey, count(*) n from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT') group by all")
def q13_species_semi_join(spark, d):
    urgent = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'")
    kept = encode.in_tree(table(spark, d, "customer"), urgent, species="c_custkey", tip="o_custkey")
    return kept.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"))


@query("select source, count(*) n from documents where not exists (select 1 from labels l where l.doc_id = documents.doc_id) group by all")
def q14_changed_groups_anti(spark, d):
    return histories.changed(table(spark, d, "documents"), table(spark, d, "labels"), "doc_id").groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("select doc_id, coalesce(quality, -1) quality, coalesce(toxic, quality, -1) toxic from documents left join labels using (doc_id)")
def q15_outgroup_coalesce(spark, d):
    labels = table(spark, d, "labels").select(F.lit("tip").alias("species"), F.col("doc_id").alias("site"), F.explode(F.create_map(F.lit("quality"), "quality", F.lit("toxic"), "toxic")).alias("gene", "state"))
    whole = encode.complete_outgroup(labels.withColumn("name", F.concat("species", "gene")), "tip", first="quality", second="toxic")
    both = whole.groupBy("site").pivot("gene", ["quality", "toxic"]).agg(F.first("state", ignorenulls=True))
    rows = table(spark, d, "documents").select("doc_id").join(both.withColumnRenamed("site", "doc_id"), "doc_id", "left")
    return rows.select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), F.coalesce("toxic", F.lit(-1)).alias("toxic"))


@query(f"""with {SEQ}, l as (select length(seq) n, count(*) m from seq group by all), p as (select n, m, unnest(range(1, n)) s from l), c as (select *, unnest([0, 1, 2]) c from p)
 select cast(c + 1 as int) cs_i, cast((c + s) % 3 + 1 as int) cs_j, cast(s as int) as space, cast(sum(m * len(range(c, n - s, 3))) as bigint) n from c where c + s >= 3 and c < n - s group by all""")
def q16_site_pairs_theta(spark, d):
    return encode.codon_site_pairs(sequences(spark, d).select(F.length("seq").alias("n_sites")), same_codon=False)


@query("select b.n_nationkey - a.n_nationkey as space, count(distinct a.n_regionkey * 10 + b.n_regionkey) codon_pairs, count(*) n from nation a join nation b on a.n_nationkey < b.n_nationkey group by all")
def q17_spaces_distinct(spark, d):
    k = F.col("n_nationkey")
    index = table(spark, d, "nation").select(k.alias("site"), k.alias("nt_index"), k.alias("codon"), F.col("n_regionkey").alias("codon_site"))
    return encode.available_pairs(encode.site_pairs(index)).select("space", F.size("codon_pairs").cast("long").alias("codon_pairs"), "n")


@query()
def q18_pair_state_counts(spark, d):
    """Every distance; SQL has to make each pair, so the test compares with every pair of a small table instead."""
    return encode.pair_state_counts(sequences(spark, d)).select("space", alphabet.pair_code(F.col("a"), F.col("b")).alias("code"), "n")


@query("with c as (select distinct l_returnflag, l_linestatus from lineitem) select l_returnflag, l_linestatus, cast(row_number() over (order by l_returnflag, l_linestatus) as int) process from c")
def q19_process_dedup(spark, d):
    return histories.numbered(table(spark, d, "lineitem"), "l_returnflag", "l_linestatus")


@query("with g as (select distinct user_id, event_type from events) select a.event_type a, b.event_type b, count(*) n from g a join g b on a.user_id = b.user_id and a.event_type < b.event_type group by all")
def q20_accessible_pairs(spark, d):
    return histories.accessible_pair_relation(table(spark, d, "events"), within="user_id", group="event_type")


@query("""with recursive e as (select 'root' p, 'r' || r_regionkey c from region union all select 'r' || n_regionkey, 'n' || n_nationkey from nation union all select 'n' || c_nationkey, 'c' || c_custkey from customer),
 w as (select c node, 1 depth, p || '/' || c path from e where p = 'root' union all select e.c, w.depth + 1, w.path || '/' || e.c from w join e on e.p = w.node)
 select node, depth, path from w where depth = 3""")
def q21_root_to_tip_paths(spark, d):
    r = table(spark, d, "region").select(F.lit("root").alias("parent"), F.concat(F.lit("r"), "r_regionkey").alias("child"))
    n = table(spark, d, "nation").select(F.concat(F.lit("r"), "n_regionkey").alias("parent"), F.concat(F.lit("n"), "n_nationkey").alias("child"))
    t = table(spark, d, "customer").select(F.concat(F.lit("n"), "c_nationkey").alias("parent"), F.concat(F.lit("c"), "c_custkey").alias("child"))
    return forest.paths(r.unionByName(n).unionByName(t), "root").filter("depth = 3")


@query("with k as (select r_regionkey, cast(dense_rank() over (order by r_name) as int) process from region) select n_nationkey, n_name, process from nation join k on n_regionkey = r_regionkey")
def q22_edge_process_assign(spark, d):
    got = histories.edge_processes(table(spark, d, "nation"), table(spark, d, "region"), parent="n_regionkey", node="r_regionkey", conf="r_name")
    return got.select("n_nationkey", "n_name", "process")


@query(f"with {TOK} select pos site, count(*) n, sum(st) total from tok group by all")
def q23_union_interleave(spark, d):
    s = sites(spark, d).withColumn("codon", F.floor(F.col("pos") / 3).cast("int"))
    three = [s.filter(F.col("pos") % 3 == k).groupBy("codon").agg(F.count(F.lit(1)).alias("n"), F.sum("st").alias("total")).withColumnRenamed("codon", "site") for k in range(3)]
    return encode.interleave(three)


@query(f"with {TOK} select pos, st, count(*) n from tok where pos in (1, 4, 9, 16, 25, 36, 49) group by all")
def q24_membership_subset(spark, d):
    return encode.at_sites(sites(spark, d), [1, 4, 9, 16, 25, 36, 49], "pos").groupBy("pos", "st").agg(F.count(F.lit(1)).alias("n"))


@query("select c_nationkey, arg_min(c_custkey, (c_acctbal, c_custkey)) c_custkey from customer group by all")
def q25_argmin_config(spark, d):
    return histories.smallest(table(spark, d, "customer"), "c_nationkey", "c_custkey", "c_acctbal", "c_custkey")


@query(f"with {TOK} select a.doc_id, count(*) sites, sum(case when a.st <> b.st then 1 else 0 end) differences, sum(case when abs(a.st - b.st) = 2 then 1 else 0 end) transitions from tok a join tok b on b.doc_id = a.doc_id + 1 and a.pos = b.pos group by all")
def q26_hamming_transitions(spark, d):
    s = sequences(spark, d).select("doc_id", "seq")
    p = s.join(s.select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("other")), "doc_id")
    return p.select("doc_id", alphabet.compared(F.col("seq"), F.col("other")).alias("c")).select("doc_id", "c.*").filter("sites > 0")


@query(f"with {CHAIN.split(' c2 as')[0].rstrip().rstrip(',')}, g as (select user_id, nt_index - lag(nt_index) over (partition by user_id order by site) gap from c1) select user_id, count(gap) steps, sum(gap) span, min(case when gap >= 0 then 1 else 0 end) monotonic from g where gap is not null group by all")
def q27_lag_distance(spark, d):
    g = encode.gaps(chains(spark, d), "user_id").filter("gap is not null")
    return g.groupBy("user_id").agg(F.count("gap").alias("steps"), F.sum("gap").alias("span"), F.min(F.when(F.col("gap") >= 0, 1).otherwise(0)).alias("monotonic"))


@query("""with h as (select distinct user_id, cast(floor(epoch(ts) / 86400) as bigint) as day from events),
 i as (select user_id, day, day - row_number() over (partition by user_id order by day) isl from h) select user_id, min(day) start, count(*) n from i group by user_id, isl""")
def q28_gaps_islands(spark, d):
    h = table(spark, d, "events").select("user_id", F.datediff("ts", F.lit("1970-01-01")).cast("long").alias("day"))
    return histories.run_relation(h, "user_id", place="day")


@query("""with h as (select user_id, cast(floor(epoch(ts) / 86400) as bigint) as day, count(*) n from events group by all),
 s as (select user_id, unnest(range(min(day), max(day) + 1)) as day from h group by user_id) select s.user_id, s.day, coalesce(n, -1) n from s left join h using (user_id, day)""")
def q29_gap_fill(spark, d):
    h = table(spark, d, "events").groupBy("user_id", F.datediff("ts", F.lit("1970-01-01")).cast("long").alias("day")).agg(F.count(F.lit(1)).alias("n"))
    return tables.fill_index(h, "user_id", place="day")


@query(f"with {COMP}, cum as (select st, sum(freq) over (order by st) hi, sum(freq) over (order by st) - freq lo from comp) select c_custkey, st from customer join cum on (c_custkey * 37 % 1000 + 0.5) / 1000 >= lo and (c_custkey * 37 % 1000 + 0.5) / 1000 < hi")
def q30_inverse_cdf(spark, d):
    c = composition(spark, d).agg(F.map_from_entries(F.collect_list(F.struct("nt", "freq"))).alias("f")).select(F.array(*[F.element_at("f", k) for k in "ACGT"]).alias("f"))
    u = table(spark, d, "customer").select("c_custkey", ((F.col("c_custkey") * 37 % 1000 + 0.5) / 1000).alias("u")).crossJoin(F.broadcast(c))  # one row
    return u.select("c_custkey", simulate.draw_column(F.col("u"), [F.get("f", F.lit(k)) for k in range(4)]).alias("st"))


def _lattice(spark, d):
    return hmm.lattice(chains(spark, d), eta=ETA, p=TRACT_P, length=LENGTH, group="user_id")


@query(f"with recursive {CHAIN}, {FORWARD} select user_id, round({LSE.format(a='a', b='b')}, 6) lnl from f where (user_id, site) in (select user_id, max(site) from c group by 1)")
def q31_hmm_forward(spark, d):
    return hmm.forward(_lattice(spark, d)).select("user_id", _r(F.col("lnl")).alias("lnl"))


@query(f"""with recursive {CHAIN}, {FORWARD}, last as (select user_id, max(site) site from c group by 1),
 b as (select user_id, site, cast(0.0 as double) a, cast(0.0 as double) b from last
  union all select c.user_id, c.site - 1, {LSE.format(a='(c.p00 + c.e0 + b.a)', b='(c.p01 + c.e1 + b.b)')}, {LSE.format(a='(c.p10 + c.e0 + b.a)', b='(c.p11 + c.e1 + b.b)')}
  from b join c on c.user_id = b.user_id and c.site = b.site where c.site > 0),
 t as (select user_id, {LSE.format(a='a', b='b')} lnl from f join last using (user_id, site))
 select f.user_id, f.site, round(exp(f.b + b.b - t.lnl), 6) posterior from f join b on f.user_id = b.user_id and f.site = b.site join t on t.user_id = f.user_id""")
def q32_hmm_backward_posterior(spark, d):
    return hmm.decode(_lattice(spark, d)).select("user_id", "site", _r(F.col("posterior")).alias("posterior"))


@query(f"""with recursive {CHAIN}, v as (select user_id, site, e0 + {-2 * ETA / TRACT_P * LENGTH} a, e1 + ln(1 - exp({-2 * ETA / TRACT_P * LENGTH})) b from c where site = 0
 union all select c.user_id, c.site, c.e0 + greatest(v.a + c.p00, v.b + c.p10), c.e1 + greatest(v.a + c.p01, v.b + c.p11) from v join c on c.user_id = v.user_id and c.site = v.site + 1)
 select user_id, round(greatest(a, b), 6) score, case when b > a then 1 else 0 end last_state from v where (user_id, site) in (select user_id, max(site) from c group by 1)""")
def q33_hmm_viterbi(spark, d):
    return hmm.viterbi(_lattice(spark, d)).select("user_id", _r(F.col("score")).alias("score"), "last_state")


@query("select o_custkey, o_orderkey, round(sum(ln(1 - o_orderkey % 9 * 0.05)) over (partition by o_custkey order by o_orderdate, o_orderkey), 6) log_height from orders")
def q34_clock_cumprod(spark, d):
    got = models.clock_heights(table(spark, d, "orders"), "o_custkey", "o_orderdate", "o_orderkey", ratio=1 - F.col("o_orderkey") % 9 * 0.05)
    return got.select("o_custkey", "o_orderkey", _r(F.col("log_height")).alias("log_height"))


@query(f"with {HKY} select x, y, round(q, 6) q from hky")
def q35_hky_rates(spark, d):
    return rate_relations.hky(composition(spark, d), KAPPA).select("x", "y", _r(F.col("q")).alias("q"))


@query(f"""with {HKY}, z as (select cast(range as int) z from range(4)), o as (select *, case when y = z then {TAU} else 0.0 end c from hky, z)
 select x * 4 + z s, y * 4 + z t, round(q + c, 6) rate, round(c / (q + c), 6) share from o union all select z * 4 + x, z * 4 + y, round(q + c, 6), round(c / (q + c), 6) from o""")
def q36_two_paralog_hky_igc(spark, d):
    return rate_relations.two_paralogs(composition(spark, d), KAPPA, TAU).select("s", "t", _r(F.col("rate")).alias("rate"), _r(F.col("share")).alias("share"))


MG94 = COMP + f""", aa as (select unnest({alphabet.SENSE_CODONS!r}) codon, unnest({[alphabet.AMINO_ACID[c] for c in alphabet.SENSE_CODONS]!r}) aa),
 w as (select codon, aa, (select freq from comp where nt = substr(codon, 1, 1)) * (select freq from comp where nt = substr(codon, 2, 1)) * (select freq from comp where nt = substr(codon, 3, 1)) w from aa),
 cp as (select a.codon a, b.codon b, a.w / (select sum(w) from w) pa, a.aa aa_a, b.aa aa_b,
  case when substr(a.codon, 1, 1) <> substr(b.codon, 1, 1) then 1 when substr(a.codon, 2, 1) <> substr(b.codon, 2, 1) then 2 else 3 end k
  from w a, w b where (substr(a.codon, 1, 1) <> substr(b.codon, 1, 1))::int + (substr(a.codon, 2, 1) <> substr(b.codon, 2, 1))::int + (substr(a.codon, 3, 1) <> substr(b.codon, 3, 1))::int = 1),
 r as (select a, b, pa, freq * case when substr(a, k, 1) || substr(b, k, 1) in ('AG', 'GA', 'CT', 'TC') then {KAPPA} else 1.0 end * case when aa_a <> aa_b then {OMEGA} else 1.0 end r from cp join comp on nt = substr(b, k, 1)),
 mg as (select a, b, r / (select sum(pa * r) from r) q from r)"""


@query(f"with {MG94} select a, b, round(q, 6) q from mg")
def q37_mg94_rates(spark, d):
    return rate_relations.mg94(composition(spark, d), KAPPA, OMEGA).select("a", "b", _r(F.col("q")).alias("q"))


TAUS = {(0, 1): 0.5, (1, 0): 1.0, (0, 2): 1.5, (2, 0): 2.0, (1, 2): 2.5, (2, 1): 3.0}
TAU_SQL = " + ".join(f"case when o = {r} and d{g} = y then {v} else 0.0 end" for (g, r), v in TAUS.items())


@query(f"""with {HKY}, st as (select cast(range as int) s, cast(range // 16 as int) d0, cast(range // 4 % 4 as int) d1, cast(range % 4 as int) d2 from range(64)), o as (select cast(range as int) o from range(3)),
 j as (select st.*, o, y, x, q from st, o join hky on x = case o when 0 then d0 when 1 then d1 else d2 end)
 select s, s + (y - x) * case o when 0 then 16 when 1 then 4 else 1 end t, round(q + {TAU_SQL}, 6) rate, round({TAU_SQL}, 6) copies from j""")
def q38_joint_state_rates(spark, d):
    return rate_relations.three_paralogs(composition(spark, d), KAPPA, TAUS).select("s", "t", _r(F.col("rate")).alias("rate"), _r(F.col("copies")).alias("copies"))


SPACE, INIT, PAIR_P = 3, 0.4, 0.2
ONE, BOTH = INIT / PAIR_P * (1 - (1 - PAIR_P) ** SPACE), INIT / PAIR_P * (1 - PAIR_P) ** SPACE
PAIR = f"""st as (select cast(range as int) s, [cast(range // 64 as int), cast(range // 16 % 4 as int), cast(range // 4 % 4 as int), cast(range % 4 as int)] d from range(256)), k as (select cast(range as int) k from range(4)),
 j as (select s, d, k, x, y, q from st, k join hky on x = d[k + 1]),
 pr as (select s, s + (y - x) * [64, 16, 4, 1][k + 1] t, q + case when d[(k + 2) % 4 + 1] = y then {ONE} + case when d[xor(k, 1) + 1] = d[(xor(k, 1) + 2) % 4 + 1] then {BOTH} else 0.0 end else 0.0 end rate from j
  union all select s, d[3] * 64 + d[4] * 16 + d[3] * 4 + d[4], {BOTH} from st where d[1] <> d[3] and d[2] <> d[4] union all select s, d[1] * 64 + d[2] * 16 + d[1] * 4 + d[2], {BOTH} from st where d[1] <> d[3] and d[2] <> d[4])"""


@query(f"with {HKY}, {PAIR} select s, t, round(rate, 6) rate from pr")
def q39_pair_site_rates(spark, d):
    return rate_relations.pair_site(composition(spark, d), KAPPA, SPACE, INIT, PAIR_P).select("s", "t", _r(F.col("rate")).alias("rate"))


@query(f"with {HKY}, {PAIR} select s, round(sum(rate), 6) total, count(*) n from pr group by s")
def q40_rate_row_sums(spark, d):
    rates = rate_relations.pair_site(composition(spark, d), KAPPA, SPACE, INIT, PAIR_P)
    return rate_relations.row_sums(rates).select("s", _r(F.col("out")).alias("total"), "n")


def _same(t):
    return f"(0.2 + 0.8 * exp(-({t})))", f"(0.2 - 0.2 * exp(-({t})))"


@query(f"""with k as (select cast(range as int) s from range(5)),
 u as (select c_nationkey nk, s, sum(ln(case when list_position({SEGMENTS!r}, c_mktsegment) - 1 = s then {_same('0.1 + c_custkey % 7 * 0.05')[0]} else {_same('0.1 + c_custkey % 7 * 0.05')[1]} end)) m from customer, k group by all),
 v as (select n_regionkey rk, n_nationkey nk, k.s, max(u.m) over (partition by n_nationkey, k.s) top, u.m, case when k.s = u.s then {_same('0.3 + n_nationkey % 3 * 0.1')[0]} else {_same('0.3 + n_nationkey % 3 * 0.1')[1]} end p from u join nation on n_nationkey = u.nk, k),
 n as (select rk, nk, s, max(top) + ln(sum(p * exp(m - top))) m from v group by all), g as (select rk, s, sum(m) m from n group by all)
 select rk region, round(max(m) + ln(sum(0.2 * exp(m - (select max(m) from g h where h.rk = g.rk)))), 6) lnl from g group by rk""")
def q41_tree_pruning(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation")
    tip = F.transform(F.array(*[F.lit(k) for k in range(5)]), lambda s: F.when(F.array_position(F.array(*map(F.lit, SEGMENTS)), F.col("c_mktsegment")) - 1 == s, F.lit(0.0)).otherwise(F.lit(float("-inf"))))
    tips = c.select("c_nationkey", (0.1 + F.col("c_custkey") % 7 * 0.05).alias("t"), tip.alias("m"))
    nations = rate_relations.prune_level(tips, 5, parent="c_nationkey", length="t")
    nations = nations.join(n, nations["c_nationkey"] == n["n_nationkey"]).select("n_regionkey", (0.3 + F.col("n_nationkey") % 3 * 0.1).alias("t"), "m")
    regions = rate_relations.prune_level(nations, 5, parent="n_regionkey", length="t")
    return regions.select(F.col("n_regionkey").alias("region"), _r(alphabet.log_sum_exp([F.get("m", F.lit(k)) for k in range(5)]) + float(np.log(0.2))).alias("lnl"))


def _model(spark, d, **kw):
    tree, axes, patterns = bridge.family_patterns(spark, d)
    model = JointModel(tree, axes, event_group={"D1": 0}, **kw)
    x = model.start(np.array([0.3, 0.2, 0.2, 0.3]), length=0.1)
    return patterns, model, x


@query()
def q42_igc_pruning_kernel(spark, d):
    patterns, model, x = _model(spark, d)
    return engine.pattern_values(patterns, {0: model.scenes(x)}).select(F.array_join("pattern", ",").alias("pattern"), "n", _r(F.col("value")).alias("lnl"))


def _by_edge(rows, model, name):
    names = F.create_map(*[v for k, (a, b) in enumerate(model.edges) for v in (F.lit(k), F.lit(f"{a}__{b}"))])
    return rows.select(F.element_at(names, F.col("edge")).alias("edge"), _r(F.col("value")).alias(name))


@query()
def q43_expected_counts(spark, d):
    patterns, model, x = _model(spark, d)
    out = None
    for w in ("copies", "mutations"):
        one = _by_edge(engine.totals(engine.pattern_values(patterns, {0: model.scenes(x)}, want="events", weights=w)), model, "expected").withColumn("event", F.lit(w))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def q44_dwell_fraction(spark, d):
    patterns, model, x = _model(spark, d)
    return _by_edge(engine.totals(engine.pattern_values(patterns, {0: model.scenes(x)}, want="dwell", weights="unlike")), model, "dwell")


@query(f"""with {TOK}, g as (select cast(range as int) eval_id, 0.1 * (range + 1) t from range(8)), p as (select a.lang, sum(case when a.st = b.st then 1 else 0 end) same, sum(case when a.st <> b.st then 1 else 0 end) other from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all)
 select eval_id, lang, round(same * ln(0.25 + 0.75 * exp(-t)) + other * ln(0.25 - 0.25 * exp(-t)), 4) lnl from p, g""")
def q45_perturbation_grid(spark, d):
    eq = F.col("sa") == F.col("sb")
    count = lambda c: F.sum(F.when(c, F.col("n")).otherwise(0))
    p = bridge.neighbour_pairs(spark, d, "lang").groupBy("lang").agg(count(eq).alias("same"), count(~eq).alias("other"))
    g = estimate.over_grid(p, {k: {"t": 0.1 * (k + 1)} for k in range(8)})
    same, other = rate_relations.equal_rates(4, F.col("t"))
    return g.select("eval_id", "lang", _r(F.col("same") * F.log(same) + F.col("other") * F.log(other), 4).alias("lnl"))


@query(f"""with {TOK}, f as (select doc_id, lang, avg((st = 0)::int) - 0.25 g0, avg((st = 1)::int) - 0.25 g1, avg((st = 2)::int) - 0.25 g2 from tok group by all), l as (select lang, unnest([0, 1, 2]) i, unnest([g0, g1, g2]) v, doc_id from f)
 select a.lang, a.i, b.i j, round(avg(a.v * b.v), 6) moment from l a join l b using (doc_id) group by all""")
def q46_godambe_moments(spark, d):
    f = sites(spark, d).groupBy("doc_id", "lang").agg(F.array(*[F.avg((F.col("st") == k).cast("int")) - 0.25 for k in range(3)]).alias("g"))
    return estimate.moments(f, "lang", k=3).withColumn("moment", _r(F.col("moment")))


@query("""with l as (select lang run, unnest(['documents', 'chars', 'sources']) label, unnest([count(*), sum(n_chars), count(distinct source)]) v from documents group by lang)
 select label, max(v) filter (run = 'de') de, max(v) filter (run = 'en') en, max(v) filter (run = 'es') es, max(v) filter (run = 'fr') fr from l group by label""")
def q47_summary_pivot(spark, d):
    s = table(spark, d, "documents").groupBy(F.col("lang").alias("run")).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"), F.countDistinct("source").alias("sources"))
    return tables.pivot_summaries(s.unpivot("run", ["documents", "chars", "sources"], "label", "value"), ["de", "en", "es", "fr"])


SIMULATED = {"init": 0.05, "p": 0.1, "sites": 60, "length": 0.2, "replicates": 40}
EDGES = [("N0", "D1"), ("D1", "N1"), ("N0", "es"), ("N1", "N2"), ("N1", "fr"), ("N2", "de"), ("N2", "en")]
BELOW = [f"{a}_{b}" for a, b in EDGES if a != "N0"]


@query(f"""with e as (select unnest({[f"{a}_{b}" for a, b in EDGES]!r}) edge), k as (select unnest(['copy', 'mutation']) kind)
 select edge, kind, round(case when kind = 'copy' then case when edge in {tuple(BELOW)!r} then 2 else 0 end * {SIMULATED["init"] * (SIMULATED["sites"] - 1 + 1 / SIMULATED["p"]) * SIMULATED["length"] * SIMULATED["replicates"]}
  else case when edge in {tuple(BELOW)!r} then 2 else 1 end * {SIMULATED["sites"] * SIMULATED["length"] * SIMULATED["replicates"]} end, 6) expected, true near,
  cast((select count(*) from documents where text is not null) as bigint) texts from e, k""")
def q48_simulate_branch(spark, d):
    """Simulated events on each edge beside what must be expected: near if within six standard errors. The letters' shares are
    those of all documents."""
    pi = {r["nt"]: r["freq"] for r in composition(spark, d).collect()}  # four rows
    pi = np.array([pi[c] for c in "ACGT"])
    tree = newick.splice(newick.parse(bridge.TREE), [("N0_N1", ["D1"])])
    s = SIMULATED
    setting = simulate.Setting(tree, histories.configurations(tree, {"D1": 0}), {e: s["length"] for e in tree.edges}, rates.hky(pi, KAPPA), pi, s["sites"], init=s["init"], p=s["p"], seed=7)
    want = spark.createDataFrame([(f"{a}_{b}", k, v) for (a, b, k), v in simulate.expected_events(setting, s["replicates"]).items()], "edge string, kind string, expected double")
    events = simulate.simulate(spark, setting, s["replicates"])[1]
    got = want.join(events.groupBy("edge", "kind").agg(F.count(F.lit(1)).alias("n")), ["edge", "kind"], "left")
    near = F.abs(F.coalesce("n", F.lit(0)) - F.col("expected")) <= 6 * F.sqrt("expected")
    texts = table(spark, d, "documents").filter("text is not null").agg(F.count(F.lit(1)).alias("texts"))
    return got.select("edge", "kind", _r(F.col("expected")).alias("expected"), near.alias("near")).crossJoin(F.broadcast(texts))  # one row


@query(f"""with recursive {CHAIN}, v as (select user_id, site, e0 + {-2 * ETA / TRACT_P * LENGTH} a, e1 + ln(1 - exp({-2 * ETA / TRACT_P * LENGTH})) b, 0 fa, 0 fb from c where site = 0
 union all select c.user_id, c.site, c.e0 + greatest(v.a + c.p00, v.b + c.p10), c.e1 + greatest(v.a + c.p01, v.b + c.p11), case when v.b + c.p10 > v.a + c.p00 then 1 else 0 end, case when v.b + c.p11 > v.a + c.p01 then 1 else 0 end
 from v join c on c.user_id = v.user_id and c.site = v.site + 1),
 w as (select user_id, site, case when b > a then 1 else 0 end state, case when b > a then fb else fa end prev from v where (user_id, site) in (select user_id, max(site) from c group by 1)
 union all select v.user_id, v.site, w.prev, case when w.prev = 1 then v.fb else v.fa end from w join v on v.user_id = w.user_id and v.site = w.site - 1)
 select user_id, cast(site as int) site, cast(state as int) state from w""")
def q49_viterbi_path(spark, d):
    return hmm.decode(_lattice(spark, d)).select("user_id", "site", "state")


#: Two states at rates 1 each way; two tips below the root, at these lengths.
T1, T2 = 0.3, 0.5
PURINES = f"""{TOK}, xy as (select a.st in (0, 2) x, b.st in (0, 2) y, count(*) n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all),
 pt as (select 1 - x::int x, 1 - y::int y, cast(sum(n) as bigint) n from xy group by all),
 s as (select range r from range(2)), e as (select unnest([0, 1]) edge, unnest([{T1}, {T2}]) t),
 f as (select pt.*, r, 0.5 + case when r = x then 0.5 else -0.5 end * exp(-2 * {T1}) p1, 0.5 + case when r = y then 0.5 else -0.5 end * exp(-2 * {T2}) p2 from pt, s),
 lik as (select x, y, n, sum(0.5 * p1 * p2) l from f group by all),
 g as (select f.x, f.y, f.n, r, edge, t, case when edge = 0 then f.x else f.y end b, case when edge = 0 then p2 else p1 end other, l from f join lik on lik.x = f.x and lik.y = f.y, e)"""


def _two_states(spark, d):
    """Purine or pyrimidine of every two letters that stand side by side: patterns of two tips."""
    kind = lambda c: F.when(c.isin(0, 2), 0).otherwise(1)
    both = bridge.neighbour_pairs(spark, d).select(F.lit(0).alias("site"), F.array(kind(F.col("sa")), kind(F.col("sb"))).alias("pattern"), "n")
    return kept(encode.compress(both, codon_position=False, n="n"))


def _two_state_tree(spark, patterns):
    """The rates, and the messages of patterns on the tree of two tips."""
    rates_ = local(spark, [(0, 0, 1, 1.0), (0, 1, 0, 1.0)], "process int, s int, t int, rate double")
    edges = local(spark, [("R", "a", 0, T1), ("R", "b", 0, T2)], "parent string, child string, process int, length double")
    prior = local(spark, [(0, 0.5), (1, 0.5)], "s int, p double")
    axes = local(spark, [(0, "a", 0), (1, "b", 0)], "axis int, node string, pos int")
    digits = local(spark, [(0, 0, 0), (1, 0, 1)], "s int, pos int, value int")
    data = likelihood.observations(patterns, axes, digits, edges)
    return rates_, likelihood.prune(data, edges, likelihood.transitions(rates_, edges, prior), prior)


def _edge():
    return F.when(F.col("child") == "a", 0).otherwise(1).alias("edge")


def _end(k):
    return F.get("pattern", F.lit(k)).alias("xy"[k])


@query(f"with {PURINES} select x, y, n, round(ln(l), 6) lnl from lik")
def q50_two_state_likelihood(spark, d):
    patterns = _two_states(spark, d)
    tree = _two_state_tree(spark, patterns)[1]
    return patterns.join(tree.lnl, "pattern").select(_end(0), _end(1), "n", _r(F.col("lnl")).alias("lnl"))


@query(f"""with {PURINES} select x, y, edge, n,
 round(sum(0.5 * other * case when r = b then t * exp(-t) * sinh(t) else t * exp(-t) * cosh(t) end) / l, 6) jumps,
 round(sum(0.5 * other * (case when r = b then t * exp(-t) * sinh(t) else t * exp(-t) * cosh(t) end + case when r = b then 0 when r = 0 then exp(-t) * sinh(t) else -exp(-t) * sinh(t) end) / 2) / l, 6) up from g group by x, y, edge, n, l""")
def q51_two_state_jumps(spark, d):
    """Expected jumps, and those from the first state to the second: with r and b the ends, half of all and half of what the ends
    differ by."""
    patterns = _two_states(spark, d)
    rates_, tree = _two_state_tree(spark, patterns)
    above = likelihood.outside(tree)
    every, up = (likelihood.expected(tree, above, likelihood.integrals(rates_, tree.edges, tree.prior, likelihood.jumps(r))) for r in (rates_, rates_.filter("s = 0")))
    both = every.withColumnRenamed("value", "jumps").join(up.withColumnRenamed("value", "up"), ["pattern", "child"])
    return patterns.join(both, "pattern").select(_end(0), _end(1), _edge(), "n", _r(F.col("jumps")).alias("jumps"), _r(F.col("up")).alias("up"))


@query(f"""with {PURINES}, z as (select *, case when r = 0 then 1 else -1 end u, case when b = 0 then 1 else -1 end w from g)
 select x, y, edge, n, round(sum(0.5 * other * 0.25 * (t + (u + w) * (1 - exp(-2 * t)) / 2 + u * w * t * exp(-2 * t)) / t) / l, 6) share from z group by x, y, edge, n, l""")
def q52_two_state_dwell(spark, d):
    patterns = _two_states(spark, d)
    rates_, tree = _two_state_tree(spark, patterns)
    zero = local(spark, [(0, 0, 0, 1.0)], "process int, s int, t int, w double")
    got = likelihood.expected(tree, likelihood.outside(tree), likelihood.integrals(rates_, tree.edges, tree.prior, zero))
    return patterns.join(got, "pattern").join(tree.edges.select("child", "length"), "child").select(_end(0), _end(1), _edge(), "n", _r(F.col("value") / F.col("length")).alias("share"))


@query(f"""with {PURINES} select edge, round(sum(n * d), 3) slope from (select x, y, edge, n, sum(0.5 * other * case when r = b then -1 else 1 end * t * exp(-2 * t)) / l d from g group by x, y, edge, n, l) group by edge""")
def q53_two_state_derivative(spark, d):
    patterns = _two_states(spark, d)
    rates_, tree = _two_state_tree(spark, patterns)
    got = likelihood.expected(tree, likelihood.outside(tree), likelihood.slopes(rates_, tree.edges, tree.trans))
    return patterns.join(got, "pattern").groupBy(_edge()).agg(F.round(F.sum(F.col("n") * F.col("value")), 3).alias("slope"))


PATTERNS = """g as (select source, lang, upper(regexp_replace(text, '[^ACGTacgt]', '', 'g')) seq, row_number() over (partition by source, lang order by doc_id) k from documents where lang in ('de', 'en', 'es', 'fr')),
 t as (select source, k, lang, unnest(range(length(seq))) pos, unnest(string_split(seq, '')) sym from g where seq <> ''),
 w as (select source, k, pos, max(case when lang = 'de' then strpos('ACGT', sym) - 1 end) de, max(case when lang = 'en' then strpos('ACGT', sym) - 1 end) en, max(case when lang = 'es' then strpos('ACGT', sym) - 1 end) es, max(case when lang = 'fr' then strpos('ACGT', sym) - 1 end) fr from t group by all)"""


@query(f"with {PATTERNS} select coalesce(de, -1) || ',' || coalesce(en, -1) || ',' || coalesce(es, -1) || ',' || coalesce(fr, -1) pattern, count(*) n from w group by all")
def q54_family_patterns(spark, d):
    return bridge.family_patterns(spark, d)[2].select(F.array_join("pattern", ",").alias("pattern"), "n")


@query(f"with {SEQ} select 'd' || doc_id || '__' || lang as name, 'd' || doc_id species, lang gene, length(seq) n, sum(length(seq)) over () total from seq where seq <> ''")
def q55_fasta_scan(spark, d):
    """Sequences written as FASTA files and read again."""
    rows = sequences(spark, d).filter("seq <> ''").select(F.concat(F.lit("d"), "doc_id", F.lit("__"), "lang").alias("name"), "seq")
    with bridge.scratch(spark) as folder:
        tables.write_fasta(rows, folder)
        got = bridge.kept(tables.read_fasta(spark, folder).select("name", "species", "gene", F.length("seq").cast("long").alias("n")))
    total = got.agg(F.sum("n").alias("total"))
    return got.crossJoin(F.broadcast(total))  # one row


@query("select n_regionkey orlg, string_agg('g' || n_nationkey || '__x', ',' order by 'g' || n_nationkey || '__x') genes from nation group by n_regionkey")
def q56_gene_groups(spark, d):
    """A gene map written as text and read again, and the genes of each group."""
    rows = table(spark, d, "nation").select(F.concat(F.lit("g"), "n_nationkey", F.lit("__x\t"), "n_regionkey"))
    with bridge.scratch(spark) as folder:
        rows.write.mode("overwrite").text(folder)
        got = bridge.kept(tables.read_gene_map(spark, folder))
    return tables.genes_by_group(got).select("orlg", F.array_join("genes", ",").alias("genes"))


@query("select cast(row_number() over (order by c_custkey * 3 + c_nationkey % 3) - 1 as int) site, cast(c_custkey * 3 + c_nationkey % 3 as int) nt_index, cast(c_custkey as int) codon, cast(c_nationkey % 3 + 1 as int) codon_site from customer")
def q57_sequence_index(spark, d):
    """A sequence index written as text and read again."""
    k, n = F.col("c_custkey"), F.col("c_nationkey") % 3
    rows = table(spark, d, "customer").select(F.concat_ws("\t", (k * 3 + n).cast("string"), k.cast("string"), (n + 1).cast("string")))
    with bridge.scratch(spark) as folder:
        rows.write.mode("overwrite").text(folder)
        return bridge.kept(tables.read_index(spark, folder).select("site", "nt_index", "codon", "codon_site"))


@query("select cast(o_orderkey as int) site, round(-o_totalprice / 1000, 6) lnl from orders")
def q58_sitewise_files(spark, d):
    """Sitewise values written as text and read again."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").cast("int").alias("site"), _r(-F.col("o_totalprice") / 1000).alias("lnl"))
    with bridge.scratch(spark) as folder:
        tables.write_sitewise(rows, folder)
        return bridge.kept(tables.read_sitewise(spark, folder)).withColumn("lnl", _r(F.col("lnl")))


@query("""with e as (select 'N0' p, 'N' || (r_regionkey + 1) c from region union all select 'N' || (n_regionkey + 1), case when n_nationkey % 5 = 0 then 'D' || n_nationkey else 'tip' || n_nationkey end from nation)
 select cast(row_number() over (order by p, c) - 1 as int) edge_id, p parent, c child, case when regexp_full_match(c, 'D[0-9]+') then 'duplication' when regexp_full_match(c, 'N[0-9]+') then 'speciation' else 'tip' end kind from e""")
def q59_newick_edges(spark, d):
    """A tree of regions and nations as Newick text, which is as long as the two small tables, and its edges."""
    n = F.col("n_nationkey")
    name = F.when(n % 5 == 0, F.concat(F.lit("D"), n.cast("string"))).otherwise(F.concat(F.lit("tip"), n.cast("string")))
    below = table(spark, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.array_sort(F.collect_list(name)), ",").alias("tips"))
    inner = F.concat(F.lit("("), "tips", F.lit(")N"), F.col("n_regionkey") + 1)
    text = below.agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(inner)), ", "), F.lit(")N0;")).alias("text"))
    return forest.laid_out(forest.edges(text.select(F.lit(0).alias("tree"), "text")), "tree").select("edge_id", "parent", "child", "kind")


@query("""with o as (select o_custkey tree, 'o' || o_orderkey child, 'N' || (o_orderkey % 3 + 1) parent, o_totalprice length from orders),
 e as (select tree, parent, child, 'tip' kind, length from o union all select distinct tree, 'N0', parent, 'speciation', null from o)
 select tree, parent, child, kind, length, case when parent = 'N0' then 1 else 2 end depth, cast(row_number() over (partition by tree order by parent, child) - 1 as int) edge_id from e""")
def q70_newick_forest(spark, d):
    """The orders of every customer as a tree of their own: Newick texts with branch lengths, to edges in layout order and depths."""
    o = table(spark, d, "orders").withColumn("inner", F.concat(F.lit("N"), F.col("o_orderkey") % 3 + 1))
    tips = o.groupBy("o_custkey", "inner").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("o"), "o_orderkey", F.lit(":"), "o_totalprice"))), ", ").alias("tips"))
    texts = tips.groupBy(F.col("o_custkey").alias("tree")).agg(F.concat(F.lit("("), F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("("), "tips", F.lit(")"), "inner"))), ","), F.lit(")N0;")).alias("text"))
    found = kept(forest.edges(texts))
    depths = forest.paths(found, by=["tree"]).select("tree", F.col("node").alias("child"), "depth")
    return forest.laid_out(found.join(depths, ["tree", "child"]), "tree").select("tree", "parent", "child", "kind", "length", "depth", "edge_id")


@query("select n_nationkey site, n_nationkey * 2 nt_index, -n_nationkey / 7.0 lnl, -n_nationkey / 7.0 - n_regionkey lnl_no from nation")
def q60_tract_sites(spark, d):
    n = table(spark, d, "nation")
    one, two = n.select(F.col("n_nationkey").alias("site"), (-F.col("n_nationkey") / 7.0).alias("lnl")), n.select(F.col("n_nationkey").alias("site"), (-F.col("n_nationkey") / 7.0 - F.col("n_regionkey")).alias("lnl"))
    index = n.select(F.col("n_nationkey").alias("site"), (F.col("n_nationkey") * 2).alias("nt_index"), F.lit(1).alias("codon_site"))
    return hmm.tract_sites(one, two, index)


SURFACE = [(-1.0, 0.36787944117144233), (-0.5, 0.6065306597126334)]
TAU_LINE = ETA / TRACT_P


def _surface_sql(log_p: float, p: float, name: str) -> str:
    inner = f"with recursive {chain_sql(TAU_LINE * p, p, LENGTH)}, {forward_sql(TAU_LINE * p, p, LENGTH)} select user_id, {LSE.format(a='a', b='b')} lnl from f where (user_id, site) in (select user_id, max(site) from c group by 1)"
    return f"select {log_p} log_p, user_id, round(lnl, 6) lnl from ({inner}) {name}"


@query(" union all ".join(_surface_sql(lp, p, f"s{k}") for k, (lp, p) in enumerate(SURFACE)))
def q61_tract_surface(spark, d):
    got = hmm.surface(chains(spark, d), tau=TAU_LINE, length=LENGTH, log_p=[lp for lp, _ in SURFACE], group="user_id")
    return got.select("log_p", "user_id", _r(F.col("lnl")).alias("lnl"))


@query(_registered["q36_two_paralog_hky_igc"][1])
def q62_joint_process_matrix(spark, d):
    """The process of two copies by the relation for any configuration."""
    got = rate_relations.joint(composition(spark, d), KAPPA, (1, 2), {(1, 2): TAU, (2, 1): TAU})
    return got.select("s", "t", _r(F.col("rate")).alias("rate"), _r(F.col("share")).alias("share"))


@query(_registered["q39_pair_site_rates"][1])
def q63_pair_site_matrix(spark, d):
    return rate_relations.pair_site(composition(spark, d), KAPPA, SPACE, INIT, PAIR_P).select("s", "t", _r(F.col("rate")).alias("rate"))


@query(_registered["q37_mg94_rates"][1])
def q64_codon_matrix(spark, d):
    return rate_relations.mg94(composition(spark, d), KAPPA, OMEGA).select("a", "b", _r(F.col("q")).alias("q"))


@query(f"""with {HKY}, z as (select cast(range as int) z from range(4))
 select x * 64 + z * 16 + x * 4 + z s, y * 64 + z * 16 + y * 4 + z t, round(q, 6) rate from hky, z union all select z * 64 + x * 16 + z * 4 + x, z * 64 + y * 16 + z * 4 + y, round(q, 6) from hky, z""")
def q65_single_lineage_pairs(spark, d):
    """Before the duplication both copies change together."""
    return rate_relations.pair_site_single(composition(spark, d), KAPPA).select("s", "t", _r(F.col("rate")).alias("rate"))


@query(f"with {COMP} select st * 21 s, round(freq, 6) prior from comp")
def q66_root_prior(spark, d):
    """The root's distribution lies on the states whose three positions agree."""
    return rate_relations.root_prior(composition(spark, d), 3).select("s", _r(F.col("prior")).alias("prior"))


@query(f"""with {HKY}, z as (select cast(range as int) z from range(4)) select x * 4 + z s, y * 4 + z t, round(q, 6) rate from hky, z union all select z * 4 + x, z * 4 + y, round(q, 6) from hky, z
 union all select cast(range as int), 16, {2 * TAU} from range(16)""")
def q67_absorbing_process(spark, d):
    """Two copies that change alone until one copies the other."""
    return rate_relations.absorbing(composition(spark, d), KAPPA, TAU).select("s", "t", _r(F.col("rate")).alias("rate"))


PARTS = f"""o as (select cast(p_partkey as int) site, cast(p_size % 2 as int) x, cast(p_partkey % 2 as int) y from part),
 s as (select range r from range(2)), e as (select unnest([0, 1]) edge, unnest([{T1}, {T2}]) t),
 f as (select site, x, y, r, 0.5 + case when r = x then 0.5 else -0.5 end * exp(-2 * {T1}) p1, 0.5 + case when r = y then 0.5 else -0.5 end * exp(-2 * {T2}) p2 from o, s),
 lik as (select site, sum(0.5 * p1 * p2) l from f group by all)"""


def _two_state_sites(spark, d):
    obs = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("site"), F.array((F.col("p_size") % 2).cast("int"), (F.col("p_partkey") % 2).cast("int")).alias("pattern"))
    return obs, kept(encode.compress(obs, codon_position=False))


@query(f"with {PARTS} select site, round(ln(l), 6) lnl from lik")
def q68_sitewise_likelihood(spark, d):
    obs, patterns = _two_state_sites(spark, d)
    tree = _two_state_tree(spark, patterns)[1]
    return obs.join(tree.lnl, "pattern").select("site", _r(F.col("lnl")).alias("lnl"))


@query(f"""with {PARTS}, g as (select f.site, r, edge, t, case when edge = 0 then x else y end b, case when edge = 0 then p2 else p1 end other, l from f join lik using (site), e)
 select site, edge, round(sum(0.5 * other * case when r = b then t * exp(-t) * sinh(t) else t * exp(-t) * cosh(t) end) / l, 6) jumps from g group by site, edge, l""")
def q69_sitewise_events(spark, d):
    obs, patterns = _two_state_sites(spark, d)
    rates_, tree = _two_state_tree(spark, patterns)
    got = likelihood.expected(tree, likelihood.outside(tree), likelihood.integrals(rates_, tree.edges, tree.prior, likelihood.jumps(rates_)))
    return obs.join(got, "pattern").select("site", _edge(), _r(F.col("value")).alias("jumps"))


#: A tree of depth three, with lengths, for families of documents.
SPECIES = [("N0", "N1", 0.2), ("N1", "N2", 0.15), ("N2", "en", 0.1), ("N2", "de", 0.3), ("N1", "fr", 0.25), ("N0", "es", 0.4)]
_CASE = lambda c: f"case {c} " + " ".join(f"when '{e[1]}' then {e[2]}" for e in SPECIES) + " end"
#: With equal substitution rates into a letter from all others, exp(q t) has a closed form; w enumerates all nodes of each pattern.
FAMILIES = f"""{COMP}, {PATTERNS}, m as (select 1 / sum(freq * (1 - freq)) mu from comp), pat as (select coalesce(de, -1) de, coalesce(en, -1) en, coalesce(es, -1) es, coalesce(fr, -1) fr, count(*) n from w group by all),
 k as (select st, freq from comp), leaf as (select range - 1 seen, unnest(case when range = 0 then [0, 1, 2, 3] else [range - 1] end) st from range(5)),
 chance as (select e.child, e.t, a.st a, b.st b, b.freq pb, mu, b.freq + exp(-mu * e.t) * ((a.st = b.st)::int - b.freq) p from (select unnest({[e[1] for e in SPECIES]!r}) child, unnest({[e[2] for e in SPECIES]!r}) t) e, k a, k b, m),
 up2 as (select x.a s2, de.seen de, en.seen en, de.st lde, en.st len, x.p * y.p v from chance x join leaf de on de.st = x.b and x.child = 'de' join chance y on y.child = 'en' and y.a = x.a join leaf en on en.st = y.b),
 up1 as (select z.a s1, up2.*, f.seen fr, f.st lfr, up2.v * z.p * y.p v1 from chance z join up2 on z.child = 'N2' and z.b = up2.s2 join chance y on y.child = 'fr' and y.a = z.a join leaf f on f.st = y.b),
 way as (select r.a s0, up1.*, e.seen es, e.st les, k.freq * up1.v1 * r.p * y.p lik from chance r join up1 on r.child = 'N1' and r.b = up1.s1 join chance y on y.child = 'es' and y.a = r.a join leaf e on e.st = y.b join k on k.st = r.a),
 lik as (select pat.de, pat.en, pat.es, pat.fr, n, sum(lik) l from pat join way using (de, en, es, fr) group by all)"""


def _families(spark, d):
    """Patterns of the families of documents, and their messages on the tree under equal rates into each letter."""
    pi = kept(composition(spark, d))
    q = rate_relations.hky(pi, 1.0).select(F.lit(0).alias("process"), F.col("x").alias("s"), F.col("y").alias("t"), F.col("q").alias("rate"))
    rates_ = kept(q)
    edges = local(spark, [(a, b, 0, t) for a, b, t in SPECIES], "parent string, child string, process int, length double")
    prior = pi.select((F.instr(F.lit("ACGT"), F.col("nt")) - 1).alias("s"), F.col("freq").alias("p"))
    axes = local(spark, [(k, n, 0) for k, n in enumerate(["de", "en", "es", "fr"])], "axis int, node string, pos int")
    digits = local(spark, [(k, 0, k) for k in range(4)], "s int, pos int, value int")
    patterns = kept(bridge.family_patterns(spark, d)[2].groupBy("pattern").agg(F.sum("n").alias("n")))
    tree = likelihood.prune(likelihood.observations(patterns, axes, digits, edges), edges, likelihood.transitions(rates_, edges, prior), prior)
    return patterns, rates_, tree


@query(f"with {FAMILIES} select de || ',' || en || ',' || es || ',' || fr pattern, n, round(ln(l), 6) lnl from lik")
def q71_tree_likelihood(spark, d):
    """Likelihoods by joins on a tree of depth three; the rates come from the letters of all documents."""
    patterns, _, tree = _families(spark, d)
    return patterns.join(tree.lnl, "pattern").select(F.array_join("pattern", ",").alias("pattern"), "n", _r(F.col("lnl")).alias("lnl"))


def _between(d_a: str, d_b: str, c: str) -> str:
    """The integral of exp(q u) diag(d) exp(q (t - u)) from a to b; c is the mean of d."""
    f = "exp(-mu * t)"
    return f"(t * {c} * pb + (1 - {f}) / mu * (pb * {d_b} + {d_a} * pb - 2 * {c} * pb) + t * {f} * ({d_a} * (a = b)::int - {d_a} * pb - pb * {d_b} + {c} * pb))"


_EDGE_ENDS = " union all ".join(f"select '{c}' child, {a} a, {b} b, lik, de, en, es, fr from way" for c, a, b in (("N1", "s0", "s1"), ("N2", "s1", "s2"), ("de", "s2", "lde"), ("en", "s2", "len"), ("fr", "s1", "lfr"), ("es", "s0", "les")))


@query(f"""with {FAMILIES}, x as ({_EDGE_ENDS}), y as (select pat.n / lik.l * x.lik weight, pat.n, x.child, x.a, x.b from x join pat using (de, en, es, fr) join lik using (de, en, es, fr)),
 ends as (select child, a, b, sum(weight) weight from y group by all), h as (select weight, chance.*, (select freq from k where st = a) pa, (select sum(freq * mu * (1 - freq)) from k) c, (select freq from k where st = 0) p0 from ends join chance using (child, a, b)),
 total as (select sum(n) n from pat)
 select child, round(sum(weight * (t * -mu * exp(-mu * t) * ((a = b)::int - pb) + {_between("mu * (1 - pa)", "mu * (1 - pb)", "c")}) / p) / (select n from total), 6) jumps,
  round(sum(weight * {_between("(a = 0)::int", "(b = 0)::int", "p0")} / p / t) / (select n from total), 6) share,
  round(sum(weight * t * -mu * exp(-mu * t) * ((a = b)::int - pb) / p) / (select n from total), 6) slope from h group by child""")
def q72_edge_expectations(spark, d):
    """By edge, means over all sites: expected jumps, the share of time in the first letter, and the slope of the log likelihood."""
    patterns, rates_, tree = _families(spark, d)
    above = likelihood.outside(tree)
    first = local(spark, [(0, 0, 0, 1.0)], "process int, s int, t int, w double")
    inner = {"jumps": likelihood.integrals(rates_, tree.edges, tree.prior, likelihood.jumps(rates_)), "share": likelihood.integrals(rates_, tree.edges, tree.prior, first), "slope": likelihood.slopes(rates_, tree.edges, tree.trans)}
    rows = None
    for name, i in inner.items():
        got = likelihood.expected(tree, above, i).withColumn("what", F.lit(name))
        rows = got if rows is None else rows.unionByName(got)
    total = patterns.agg(F.sum("n").alias("total"))
    mean = patterns.join(rows, "pattern").groupBy("child").pivot("what", list(inner)).agg(F.sum(F.col("n") * F.col("value")))
    mean = mean.join(tree.edges.select("child", "length"), "child").crossJoin(F.broadcast(total))  # one row
    return mean.select("child", _r(F.col("jumps") / F.col("total")).alias("jumps"), _r(F.col("share") / F.col("length") / F.col("total")).alias("share"), _r(F.col("slope") / F.col("total")).alias("slope"))


COPIED = {"synonymous": 1.5, "other": 0.6}


@query(f"""with {MG94}, i as (select cast(unnest(range(61)) as int) st, unnest({alphabet.SENSE_CODONS!r}) codon, unnest({[alphabet.AMINO_ACID[c] for c in alphabet.SENSE_CODONS]!r}) aa),
 ch as (select x.st x, y.st y, q from mg join i x on x.codon = a join i y on y.codon = b), tau as (select x.st x, z.st z, case when x.aa = z.aa then {COPIED["synonymous"]} else {COPIED["other"]} end v from i x, i z where x.st <> z.st),
 al as (select x, y, z.st z, q rate, 0.0 copied from ch, i z union all select x, z, z, v, v from tau), pr as (select x * 61 + z s, y * 61 + z t, rate, copied from al union all select z * 61 + x, z * 61 + y, rate, copied from al)
 select 0 process, x * 62 s, y * 62 t, round(q, 6) rate, 0.0::double share from ch union all select 1, s, t, round(sum(rate), 6), round(sum(copied) / sum(rate), 6) from pr group by s, t""")
def q73_codon_pair_rates(spark, d):
    """The 70,966 rates of two codon copies: 526 before the duplication, 70,440 after it."""
    got = rate_relations.codon_pair(composition(spark, d), KAPPA, OMEGA, COPIED["synonymous"], COPIED["other"])
    return got.select("process", "s", "t", _r(F.col("rate")).alias("rate"), _r(F.col("share")).alias("share"))


WEIGHTS, STEP = (0.4, -0.7), 1e-3


@query(f"""with {TOK}, p as (select a.lang, sum((a.st = b.st)::int) n0, sum((abs(a.st - b.st) = 2)::int) n1, sum((abs(a.st - b.st) in (1, 3))::int) n2, count(*)::double n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all),
 e as (select exp({WEIGHTS[0]}) / (1 + exp({WEIGHTS[0]}) + exp({WEIGHTS[1]})) q0, exp({WEIGHTS[1]}) / (1 + exp({WEIGHTS[0]}) + exp({WEIGHTS[1]})) q1),
 m as (select lang, (n1 * (1 - q0) * (1 - q0) + (n0 + n2) * q0 * q0) / n j00, (n0 * q0 * q1 - n1 * (1 - q0) * q1 - n2 * q0 * (1 - q1)) / n j01, (n2 * (1 - q1) * (1 - q1) + (n0 + n1) * q1 * q1) / n j11,
  q0 * (1 - q0) h00, -q0 * q1 h01, q1 * (1 - q1) h11 from p, e), g as (select *, j00 * j11 - j01 * j01 det from m)
 select lang, i, j, round(case when i + j = 0 then j00 when i + j = 1 then j01 else j11 end, 5) moment, round(-case when i + j = 0 then h00 when i + j = 1 then h01 else h11 end, 5) hessian,
  round(case when i + j = 0 then (h00 * h00 * j11 - 2 * h00 * h01 * j01 + h01 * h01 * j00) when i + j = 1 then (h00 * h01 * j11 - h00 * h11 * j01 - h01 * h01 * j01 + h01 * h11 * j00) else (h01 * h01 * j11 - 2 * h01 * h11 * j01 + h11 * h11 * j00) end / det, 4) godambe
 from g, (select cast(range // 2 as int) i, cast(range % 2 as int) j from range(4))""")
def q74_godambe_information(spark, d):
    """Two letters side by side are equal, a transition or a transversion, with weights 1, exp(a), exp(b): derivatives by a and b from
    a stencil, and the information that they have, by language."""
    params = local(spark, list(enumerate(WEIGHTS)), "i int, x double")
    terms = stencils.terms(params, STEP)
    at = stencils.points(params, terms).groupBy("point").pivot("i", [0, 1]).agg(F.first("x"))
    kinds = local(spark, [("same",), ("transition",), ("transversion",)], "kind string")
    a, b = F.col("0"), F.col("1")
    lnl = F.when(F.col("kind") == "transition", a).when(F.col("kind") == "transversion", b).otherwise(0.0) - F.log(1 + F.exp(a) + F.exp(b))
    got = stencils.derivatives(at.crossJoin(kinds).select("point", "kind", lnl.alias("value")), terms, "kind")
    kind = F.when(F.col("sa") == F.col("sb"), "same").when(F.abs(F.col("sa") - F.col("sb")) == 2, "transition").otherwise("transversion")
    n = bridge.neighbour_pairs(spark, d, "lang").groupBy("lang", kind.alias("kind")).agg(F.sum("n").alias("n"))
    means = stencils.means(got, n, "kind", "lang")
    both = means.join(stencils.godambe(means, "lang"), ["lang", "i", "j"])
    return both.select("lang", "i", "j", F.round("moment", 5).alias("moment"), F.round("hessian", 5).alias("hessian"), F.round("value", 4).alias("godambe"))


SPANS = [("b0", 0, 20_000), ("b1", 20_000, 50_000), ("b2", 60_000, 100_000)]


@query(f"""with w as (select user_id, event_id, cast(round(value * 100) as bigint) wait, ts from events), c as (select *, sum(wait) over (partition by user_id order by ts, event_id rows unbounded preceding) as total from w),
 b as (select unnest({[b for b, _, _ in SPANS]!r}) branch, unnest({[x for _, x, _ in SPANS]!r}) begin_, unnest({[y for _, _, y in SPANS]!r}) until_)
 select user_id, event_id, cast(total as bigint) as "at", branch, cast(total - begin_ as bigint) as since from c join b on total >= begin_ and total < until_""")
def q75_waiting_times(spark, d):
    """Users' events as waiting times, until they leave the branches."""
    e = table(spark, d, "events").select("user_id", "event_id", "ts", F.round(F.col("value") * 100).cast("long").alias("wait"))
    timed = waits.moments(e, "user_id", ["ts", "event_id"], "wait", F.to_date("ts")).select("user_id", "event_id", "at")
    spans = F.inline(F.array(*[F.struct(F.lit(b).alias("branch"), F.lit(x).cast("long").alias("begin"), F.lit(y).cast("long").alias("until")) for b, x, y in SPANS]))
    branches = table(spark, d, "events").select("user_id").distinct().select("user_id", spans)
    return waits.on_branches(timed, branches, "user_id")


@query("""with l as (select source run, unnest(['documents', 'chars', 'longest']) label, unnest([count(*), sum(n_chars), max(n_chars)])::double v from documents group by source)
 select run, label, v value, avg(v) over (partition by label) mean from l""")
def q76_summary_files(spark, d):
    """A summary file for every source, written and read again in one scan, beside the mean over all."""
    s = table(spark, d, "documents").groupBy(F.col("source").alias("run")).agg(F.count(F.lit(1)).cast("double").alias("documents"), F.sum("n_chars").cast("double").alias("chars"), F.max("n_chars").cast("double").alias("longest"))
    rows = s.select("run", F.posexplode(F.array(*[F.struct(F.lit(c).alias("label"), F.col(c).alias("value")) for c in ("documents", "chars", "longest")])).alias("place", "x")).select("run", "place", "x.*")
    with bridge.scratch(spark) as folder:
        tables.write_summaries(rows, folder)
        got = kept(tables.summaries(spark, folder).select("run", "label", "value"))
    return got.join(got.groupBy("label").agg(F.avg("value").alias("mean")), "label").select("run", "label", "value", "mean")


@query("""with c as (select o_custkey tree, count(distinct o_orderstatus = 'F') filter (o_orderkey % 2 = 0) a, count(distinct o_orderstatus) filter (o_orderkey % 2 = 1) b from orders group by 1)
 select tree, 1 + greatest(a, b) positions, 1 + a as one, 1 + b as two from c""")
def q77_configuration_search(spark, d):
    """Two lineages of every customer, with as many duplications as the even orders are finished or not, and the odd ones have kinds of status: the
    positions that the smallest joint state needs, and the groups at both tips. The second lineage shares out positions that the first has made."""
    o = table(spark, d, "orders")
    kinds = lambda odd, of: F.countDistinct(F.when(F.pmod("o_orderkey", F.lit(2)) == odd, of)).cast("int")
    n = o.groupBy(F.col("o_custkey").alias("tree")).agg(kinds(0, F.col("o_orderstatus") == "F").alias("a"), kinds(1, F.col("o_orderstatus")).alias("b"))
    step = lambda at, node, parent, kind, place: F.struct(at.cast("int").alias("step"), node.alias("node"), parent.alias("parent"), F.lit(kind).alias("kind"), F.lit(place).cast("int").alias("at"))
    name = lambda k: F.concat(F.lit("D"), k.cast("string"))
    above = lambda k, first: F.when(k == first, "N0").otherwise(name(k - 1))
    line = lambda first, count, shift: F.when(count > 0, F.transform(F.sequence(first, first + count - 1), lambda k: step(k + shift, name(k), above(k, first), "duplication", 0))).otherwise(F.array().cast("array<struct<step:int,node:string,parent:string,kind:string,at:int>>"))
    a, b = F.col("a"), F.col("b")
    ends = [step(F.lit(0), F.lit("N0"), F.lit(None).cast("string"), "speciation", None), step(a + 1, F.lit("a"), above(a + 1, F.lit(1)), "tip", None), step(a + b + 2, F.lit("b"), above(a + b + 1, a + 1), "tip", None)]
    steps = n.select("tree", F.explode(F.concat(F.array(*ends), line(F.lit(1), a, 0), line(a + 1, b, 1))).alias("e")).select("tree", "e.*")
    got = histories.searched(steps)
    groups = lambda tip: F.max(F.when(F.col("node") == tip, F.size(F.array_distinct(F.transform("conf", lambda x: x["orlg"]))))).cast("long")
    return got.groupBy("tree").agg(F.max(F.size("conf")).cast("long").alias("positions"), groups("a").alias("one"), groups("b").alias("two"))


@query("""with g as (select o_custkey family, 't' || (o_orderkey % 5) || '__o' || o_orderkey as name, 't' || (o_orderkey % 5) as node, o_orderkey % 3 as orlg from orders),
 c as (select distinct family, 't' || k as node, pos, (pos + k) % 3 as orlg, (family + pos + k) % 4 <> 0 as alive from g, (select unnest(range(5)) k), (select unnest(range(3)) pos)),
 r as (select g.family, name, g.node, pos from g join c on c.family = g.family and c.node = g.node and c.orlg = g.orlg and alive
  union all select family, 'distinct', node, pos from c where not alive and exists (select 1 from g where g.family = c.family and g.node = c.node))
 select family, cast(row_number() over (partition by family order by name, node, pos) - 1 as int) as axis, name, node, cast(pos as int) as pos from r""")
def q78_observation_axes(spark, d):
    """Every customer's orders as the genes of a family, with a configuration of three positions for each of five species."""
    o = table(spark, d, "orders")
    species = lambda k: F.concat(F.lit("t"), k.cast("string"))
    genes = o.select(F.col("o_custkey").alias("family"), F.concat(species(F.col("o_orderkey") % 5), F.lit("__o"), "o_orderkey").alias("gene"), (F.col("o_orderkey") % 3).cast("int").alias("orlg"))
    places = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(p).alias("pos")) for k in range(5) for p in range(3)]))
    confs = genes.select("family").distinct().select("family", places.alias("e")).select("family", species(F.col("e.k")).alias("node"), "e.pos", ((F.col("e.pos") + F.col("e.k")) % 3).alias("orlg"), F.when((F.col("family") + F.col("e.pos") + F.col("e.k")) % 4 != 0, 1).otherwise(0).alias("alive"))
    return encode.axes(genes, confs, "family")


CLASSES = list(range(1, 51))


@query(f"""with {PARTS}, g as (select f.site, r, edge, t, case when edge = 0 then x else y end b, case when edge = 0 then p2 else p1 end other, l from f join lik using (site), e),
 j as (select site, edge, sum(0.5 * other * case when r = b then t * exp(-t) * sinh(t) else t * exp(-t) * cosh(t) end) / l jumps from g group by site, edge, l)
 select edge, {", ".join(f'round(avg(jumps) filter (p_size = {k}), 6) as "{k}"' for k in CLASSES)} from j join part on p_partkey = site group by edge""")
def q79_posterior_matrix(spark, d):
    """Mean expected jumps as a matrix: a row an edge, a column a size of parts."""
    obs, patterns = _two_state_sites(spark, d)
    rates_, tree = _two_state_tree(spark, patterns)
    got = likelihood.expected(tree, likelihood.outside(tree), likelihood.integrals(rates_, tree.edges, tree.prior, likelihood.jumps(rates_)))
    sizes = table(spark, d, "part").select(F.col("p_partkey").cast("int").alias("part"), F.col("p_size").alias("size"))
    rows = obs.join(got, "pattern").join(sizes, F.col("site") == F.col("part")).groupBy(_edge(), F.col("size").alias("site")).agg(_r(F.avg("value")).alias("value"))
    return engine.posterior_matrix(rows, CLASSES)


@query("""select user_id, event_type, cast(count(*) as bigint) as n, cast(sum(cast(round(value * 100) as bigint)) as bigint) as cents, min(event_id) as first, max(event_id) as last from events group by user_id, event_type""")
def q80_event_log(spark, d):
    """Events streamed into a log, then streamed again by a query without memory of that: each batch replaces itself."""
    schema = table(spark, d, "events").schema
    with bridge.scratch(spark) as folder:
        for attempt in range(2):
            events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{d}/events.parquet*")  # a stream takes folders and patterns
            log_stream(events, f"{folder}/log", f"{folder}/attempt-{attempt}").awaitTermination()
        log = spark.read.parquet(f"{folder}/log")
        cents = F.sum(F.round(F.col("value") * 100).cast("long")).alias("cents")
        return kept(log.groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n"), cents, F.min("event_id").alias("first"), F.max("event_id").alias("last")))


@query(f"""with {SEQ}, a as (select source, seq, lang || '__' || (doc_id % 50) as name, case when doc_id % 50 < 40 then lang end as gene from seq),
 w as (select source, length(seq) n, max(length(seq)) over (partition by source) top, gene, row_number() over (partition by source, name) nth from a),
 c as (select source, unnest(['lengths', 'genes', 'names', 'threes']) as problem, unnest([count(*) filter (n <> top), count(*) filter (gene is null), count(*) filter (nth > 1), count(*) filter (n % 3 <> 0)]) as n from w group by source)
 select * from c where n > 0""")
def q81_alignment_violations(spark, d):
    """All that keeps the documents of each source from being an alignment of codons."""
    seqs = sequences(spark, d).select("source", F.coalesce("seq", F.lit("")).alias("seq"), F.concat("lang", F.lit("__"), (F.col("doc_id") % 50).cast("string")).alias("name"), F.when(F.col("doc_id") % 50 < 40, F.col("lang")).alias("gene"))
    return tables.alignment_violations(seqs, "source", coding=True)


@query(f"""with {TOK}, p as (select a.source, sum((abs(a.st - b.st) = 2)::int) n1, sum((abs(a.st - b.st) in (1, 3))::int) n2, count(*)::double n from tok a join tok b on a.doc_id = b.doc_id and b.pos = a.pos + 1 group by all),
 e as (select exp({WEIGHTS[0]}) / (1 + exp({WEIGHTS[0]}) + exp({WEIGHTS[1]})) q0, exp({WEIGHTS[1]}) / (1 + exp({WEIGHTS[0]}) + exp({WEIGHTS[1]})) q1)
 select 'a' place, round(sum((n1 - n * q0) / n), 5) as value, count(*) families from p, e union all select source || ':b', round((n2 - n * q1) / n, 5), 1 from p, e""")
def q82_shared_parameters(spark, d):
    """Sources as families: the weight of transitions is shared, that of transversions each one's own; means of their derivatives, in one vector."""
    params = local(spark, list(enumerate(WEIGHTS)), "i int, x double")
    terms = stencils.terms(params, STEP)
    at = stencils.points(params, terms).groupBy("point").pivot("i", [0, 1]).agg(F.first("x"))
    apart = F.abs(F.col("sa") - F.col("sb"))
    n = bridge.neighbour_pairs(spark, d, "source").groupBy("source").agg(F.sum("n").alias("n"), F.sum(F.when(apart == 2, F.col("n")).otherwise(0)).alias("n1"), F.sum(F.when(apart.isin(1, 3), F.col("n")).otherwise(0)).alias("n2"))
    a, b = F.col("0"), F.col("1")
    mean = (F.col("n1") * a + F.col("n2") * b) / F.col("n") - F.log(1 + F.exp(a) + F.exp(b))
    n = kept(n)
    values = n.crossJoin(F.broadcast(at)).select("point", "source", mean.alias("value"))  # the points of two parameters
    name = F.when(F.col("i") == 0, "a").otherwise("b").alias("name")
    got = stencils.derivatives(values, terms, "source").filter("j is null").select(F.col("source").alias("family"), name, "value")
    names = n.select(F.col("source").alias("family"), F.explode(F.array(*[F.struct(F.lit(k).alias("name"), F.lit(k == "a").alias("shared")) for k in "ab"])).alias("e")).select("family", "e.*")
    return shared.gradient(got, names).select("place", F.round("value", 5).alias("value"), "families")


def _em(x: str) -> str:
    """Chance of the ends of an edge and jumps between them, if d says that the ends differ."""
    return f"{{d}} * exp(-t{x}) * sinh(t{x}) + (1 - {{d}}) * exp(-t{x}) * cosh(t{x})"


def _em_jumps(x: str) -> str:
    return f"sum(n * (l1 * (d{x} * t{x} / tanh(t{x}) + (1 - d{x}) * t{x} * tanh(t{x})) + l2 * ((1 - d{x}) * t{x} / tanh(t{x}) + d{x} * t{x} * tanh(t{x}))) / (l1 + l2)) / sum(n)"


ROUNDS = 3


@query(f"""with recursive b as (select (l_linenumber + (l_discount > 0.095)::int) % 2 a, (l_linenumber + (l_tax > 0.075)::int) % 2 b, (l_linenumber + (l_quantity > 42.5)::int) % 2 c from lineitem),
 pat as (select (a <> m)::int da, (b <> m)::int db, (c <> m)::int dc, count(*) n from (select *, (a + b + c >= 2)::int m from b) group by all),
 em as (select 0 k, 0.0::double lnl, 0.1::double ta, 0.2::double tb, 0.3::double tc union all
  select k + 1, sum(n * ln(0.5 * (l1 + l2))), {", ".join(_em_jumps(x) for x in "abc")} from (select *, {" * ".join("(" + _em(x).format(d="d" + x) + ")" for x in "abc")} l1, {" * ".join("(" + _em(x).format(d=f"(1 - d{x})") + ")" for x in "abc")} l2 from em, pat where k < {ROUNDS}) group by k)
 select unnest(['a', 'b', 'c']) child, round(unnest([ta, tb, tc]), 6) length, round(lnl, 3) lnl from em where k = {ROUNDS}""")
def q83_length_em(spark, d):
    """Three tips with a letter of two kinds each, whose ancestor is not seen: lengths after some rounds, and the likelihood before the last."""
    bit = lambda c: ((F.col("l_linenumber") + c.cast("int")) % 2).cast("int")
    tips = F.array(bit(F.col("l_discount") > 0.095), bit(F.col("l_tax") > 0.075), bit(F.col("l_quantity") > 42.5))
    patterns = kept(table(spark, d, "lineitem").groupBy(tips.alias("pattern")).agg(F.count(F.lit(1)).alias("n")))
    rates_ = local(spark, [(0, 0, 1, 1.0), (0, 1, 0, 1.0)], "process int, s int, t int, rate double")
    edges = local(spark, [("R", "a", 0, 0.1), ("R", "b", 0, 0.2), ("R", "c", 0, 0.3)], "parent string, child string, process int, length double")
    prior = local(spark, [(0, 0.5), (1, 0.5)], "s int, p double")
    axes = local(spark, [(k, n, 0) for k, n in enumerate("abc")], "axis int, node string, pos int")
    digits = local(spark, [(0, 0, 0), (1, 0, 1)], "s int, pos int, value int")
    got, history = lengths.fit(likelihood.observations(patterns, axes, digits, edges), patterns, edges, rates_, prior, rounds=ROUNDS)
    last = history.agg(F.max_by("lnl", "round").alias("lnl"))  # one row
    return got.crossJoin(F.broadcast(last)).select("child", _r(F.col("length")).alias("length"), _r(F.col("lnl"), 3).alias("lnl"))


CHANCES = ((0.6, 0.4), ((0.9, 0.1), (0.2, 0.8)))


@query(f"""with recursive c as (select user_id, row_number() over (partition by user_id order by ts, event_id) - 1 site, -0.25 * strpos('sepvc', substr(event_type, 1, 1)) e0, -1.0 + 0.1 * strpos('sepvc', substr(event_type, 1, 1)) e1,
  {", ".join(f"ln({CHANCES[1][i][j]}) p{i}{j}" for i in (0, 1) for j in (0, 1))} from events),
 f as (select user_id, site, (e0 + ln({CHANCES[0][0]}))::double a, (e1 + ln({CHANCES[0][1]}))::double b from c where site = 0
  union all select c.user_id, c.site, c.e0 + {LSE.format(a='(f.a + c.p00)', b='(f.b + c.p10)')}, c.e1 + {LSE.format(a='(f.a + c.p01)', b='(f.b + c.p11)')} from f join c on c.user_id = f.user_id and c.site = f.site + 1)
 select user_id, site + 1 seen, round({LSE.format(a='a', b='b')}, 6) lnl from f where (user_id, site) in (select user_id, max(site) from c group by 1)""")
def q84_forward_stream(spark, d):
    """The forward sum of every user's events as a stream: the last state that each user's chain came to."""
    kind = F.instr(F.lit("sepvc"), F.substring("event_type", 1, 1))
    with bridge.scratch(spark) as folder:
        events = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/events.parquet*")  # all files at once: they need not follow each other in time
        rows = events.select(F.col("user_id").cast("string").alias("key"), F.col("ts").cast("timestamp").alias("ts"), "event_id", (kind * -0.25).alias("e0"), (kind * 0.1 - 1.0).alias("e1"))
        log_stream(forward_stream(rows, *CHANCES, remember=400 * 86_400_000, order=["event_id"]), f"{folder}/log", f"{folder}/state", mode="update").awaitTermination()
        log = spark.read.schema("key string, seen long, lnl double").parquet(f"{folder}/log")
        return kept(log.groupBy(F.col("key").cast("long").alias("user_id")).agg(F.max("seen").alias("seen"), _r(F.max_by("lnl", "seen")).alias("lnl")))


PLACES = ([(1, 1), (1, 1), (2, 1), (2, 0)], [(0, 1), (0, 1), (0, 1), (1, 0)], [(0, 1), (1, 1), (1, 1), (2, 0)])


@query(f"""with {SEQ}, w as (select lang, cast(doc_id % 3 as int) kind, seq, unnest(range(1, length(seq) - 4)) i from seq),
 c as (select lang, kind, {", ".join(f"substr(seq, i{f' + {k}' if k else ''}, 1) a{k}" for k in range(6))} from w),
 s as (select *, kind <> 0 valid, case kind when 0 then a0 = a1 when 1 then a0 = a1 and a1 = a2 else a1 = a2 end sa, case kind when 0 then a2 = a3 when 1 then a2 = a3 and a3 = a4 else a3 = a4 end sb,
  (a0 <> a2)::int d0, (a1 <> a3)::int d1, (a2 <> a4)::int d2, (a3 <> a5)::int d3 from c)
 select lang, kind, valid, count(*) n, count(*) filter (sa) states, count(*) filter (sa and sb and d3 = 0 and case kind when 0 then d0 + d2 when 1 then d0 else d0 + d1 end = 1) changes,
  count(*) filter (d0 + d1 + d2 + d3 = 1 or (d0 = 1 and d1 = 1 and d2 = 0 and d3 = 0) or (d0 = 0 and d1 = 0 and d2 = 1 and d3 = 1 and a4 = a0 and a5 = a1)) pairs from s group by all""")
def q85_state_changes(spark, d):
    """Letters of documents as states of four places, each beside that two letters on: how many are states, and are one change apart,
    in the configuration of their document and as pairs of sites."""
    confs = F.array(*[F.array(*[F.struct(F.lit(o).alias("orlg"), F.lit(a).alias("alive")) for o, a in c]) for c in PLACES])
    codes = F.transform(F.filter(F.split("seq", ""), lambda c: c != ""), lambda c: alphabet.nucleotide_state(c))
    rows = sequences(spark, d).select("lang", (F.col("doc_id") % 3).cast("int").alias("kind"), codes.alias("codes"))
    windows = F.arrays_zip(*[F.slice("codes", k + 1, F.greatest(F.size("codes") - 5, F.lit(0))).alias(f"a{k}") for k in range(6)])
    w = rows.select("lang", "kind", F.explode(windows).alias("w"))
    w = w.select("lang", "kind", F.array(*[F.col(f"w.a{k}") for k in range(4)]).alias("a"), F.array(*[F.col(f"w.a{k}") for k in range(2, 6)]).alias("b"))
    # equal windows of one kind are alike, and there are at most 3 x 4^6 of them in a language
    w = w.groupBy("lang", "kind", "a", "b").agg(F.count(F.lit(1)).alias("n")).withColumn("c", F.get(confs, F.col("kind")))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    of = lambda ok: F.sum(F.when(ok, F.col("n")).otherwise(0))
    return w.groupBy("lang", "kind", states.is_configuration(c).alias("valid")).agg(F.sum("n").alias("n"), of(states.is_state_of(a, c)).alias("states"), of(states.is_change_of(a, b, c)).alias("changes"), of(states.is_pair_change(a, b)).alias("pairs"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likelihood of every site pattern of the families that the documents make, under substitution and copying."""
    return q42_igc_pruning_kernel(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, (f, _) in _registered.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in _registered.items() if sql}

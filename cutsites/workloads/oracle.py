"""Plain SQL for every registered query, to be run by another engine on the same tables.

The statements follow the definitions directly (running windows over whole contigs,
range joins without bins, stepwise means) and share no logic with the Spark plans.
"""

from __future__ import annotations

from cutsites.workloads.fixtures import KNOWN

_M = "case m when 0 then 'L1' when 1 then 'L2' when 2 then 'TA' else 'TC' end"


def _sample(two: bool, kind: str) -> str:
    """Recoded sample key."""
    species = "case sp when 0 then 'A1|' else 'B1|' end" if two else "'spA|'"
    return f"concat({species}, {_M}, '|r', cast(rep as varchar), '|', {kind})"


def _fragments(control: bool, two: bool = False) -> str:
    kind = "case when q >= 46 then 'endo' else l_returnflag end" if control else "l_returnflag"
    only = "where m <> 1" if control else ""
    return f"""
select chr,
       cast(case when strand = '+' then pos - 1 else pos - 20 - q end as bigint) as "start",
       cast(case when strand = '+' then pos + 19 + q else pos end as bigint) as "end",
       case when q <= 2 then 'capped' else 'uncapped' end as type,
       q as count_frag, strand,
       {_sample(two, kind)} as sample
from (select *, 201 + cast(floor(k / 3.0) as bigint) * 40 + (k % 3) * 2 as pos
      from (select l_returnflag, l_linenumber % 2 as sp,
                   concat('chr', cast(l_partkey % 5 + 1 as varchar)) as chr,
                   cast(floor(l_partkey / 5.0) as bigint) as k,
                   case l_linestatus when 'O' then '+' else '-' end as strand,
                   cast(l_quantity as bigint) as q,
                   l_orderkey % 3 + 1 as rep,
                   cast(floor(l_orderkey / 3.0) as bigint) % 4 as m
            from lineitem)) {only}"""


def _spike(two: bool = False) -> str:
    kind = "case when q <= 2 then 'capped' else 'uncapped' end" if two else "'uncapped'"
    return f"""
select chr,
       cast(case when strand = '+' then pos - 1 else pos - 20 end as bigint) as "start",
       cast(case when strand = '+' then pos + 19 else pos end as bigint) as "end",
       {kind} as type, q as count_frag, strand,
       {_sample(two, "case t when 0 then 'A' when 1 then 'N' else 'R' end")} as sample
from (select concat('spike', cast(o_custkey % 3 + 1 as varchar)) as chr, 101 + o_custkey % 20 as pos, o_custkey % 2 as sp,
             case when o_orderkey % 2 = 0 then '+' else '-' end as strand, 1 + o_orderkey % 10 as q,
             o_orderkey % 3 + 1 as rep, cast(floor(o_orderkey / 3.0) as bigint) % 4 as m,
             cast(floor(o_orderkey / 12.0) as bigint) % 3 as t
      from orders)"""


def _in_list(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _islands(source: str, keys: str, gap: int) -> str:
    """Rows of ``source`` with the number of their merged region."""
    return f"""
select *, sum(opens) over (partition by {keys} order by "start", "end", end5, library_method
                           rows unbounded preceding) as region
from (select *, case when "start" - max("end") over (
                       partition by {keys} order by "start", "end", end5, library_method
                       rows between unbounded preceding and 1 preceding) <= {gap} then 0 else 1 end as opens
      from {source})"""


# Contigs of each species.
_MAIN = "('spA', 'chr1'), ('spA', 'chr2'), ('spA', 'chr3'), ('spB', 'chr3'), ('spB', 'chr4'), ('spB', 'chr5')"

_CPM_ORDER = "round(cpm_end5_mean, 6) desc nulls last, id"

_SITE_ID = "concat(species, '|', chr, '|', strand, '|', cast(end5 as varchar), '|', library_method)"


def pipeline(
    methods=("L1", "L2", "TA", "TC"),
    control: bool = False,
    filters: str = "",
    tiers: str = "case when n >= 4 then 't0' when n = 3 then 't1' when n = 2 then 't2' end",
    edge: bool = False,
    two: bool = False,
) -> dict[str, str]:
    """Named steps in dependency order."""
    steps: dict[str, str] = {}
    steps["frags"] = _fragments(control, two)
    steps["spike"] = _spike(two)
    species = "case split_part(sample, '|', 1) when 'A1' then 'spA' when 'B1' then 'spB' end" if two else "'spA'"
    steps["sizes"] = """
select sample, cast(sum(count_frag) as bigint) as count_frag_sample
from (select sample, count_frag from frags union all select sample, count_frag from spike) group by sample"""
    steps["counts_all"] = f"""
select {species} as species, sample, split_part(sample, '|', 2) as library_method,
       split_part(sample, '|', 3) as sample_rep, split_part(sample, '|', 4) as sample_type,
       chr, strand, end5, cast(sum(count_frag) as bigint) as count_end5
from (select *, case when strand = '+' then "start" + 1 else "end" end as end5 from frags where type <> 'capped')
group by all"""
    steps["counts"] = "select * from counts_all where sample_type <> 'endo'" + (f" and (species, chr) in ({_MAIN})" if two else "")
    steps["design"] = """
select split_part(sample, '|', 2) as library_method,
       count(distinct split_part(sample, '|', 3)) as n_rep, count(distinct split_part(sample, '|', 4)) as n_type
from sizes where sample not like '%endo%' group by 1"""
    steps["rep_sums"] = """
select species, c.library_method, chr, strand, end5, sample_rep,
       sum(count_end5 * 1e6 / count_frag_sample) as cpm_end5_sum
from counts c join sizes using (sample) group by all"""
    steps["hits"] = """
select * exclude (n, n_rep, n_type) from (
  select r.*, n_rep, n_type, count(*) over (partition by species, r.library_method, chr, strand, end5) as n
  from rep_sums r join design d on r.library_method = d.library_method)
where n >= n_rep"""
    steps["sites"] = f"""
select *, {_SITE_ID} as id, end5 - 1 as "start", end5 as "end" from (
  select species, h.library_method, chr, strand, end5,
         sum(cpm_end5_sum) / (max(n_type) * max(n_rep)) as cpm_end5_mean
  from hits h join design d on h.library_method = d.library_method group by all)"""
    steps["site_islands"] = _islands("sites", "species, library_method, chr, strand", 5)
    steps["regions"] = """
select species, library_method, chr, strand, region, min("start") as region_start, max("end") as region_end,
       count(*) as n_sites
from site_islands group by all"""
    steps["best_all"] = f"""
select * exclude (rn) from (
  select s.* exclude ("start", "end", opens, region), r.region_start, r.region_end,
         row_number() over (partition by r.species, r.library_method, r.chr, r.strand, r.region order by {_CPM_ORDER}) as rn
  from site_islands s join regions r
    on s.species = r.species and s.library_method = r.library_method and s.chr = r.chr and s.strand = r.strand
       and s.region = r.region)
where rn = 1"""
    steps["genome_len"] = """
select concat('chr', cast(c as varchar)) as chr, length
from (values (1), (2), (3), (4), (5)) v(c),
     (select 400 + 40 * cast(floor(max(l_partkey) / 15.0) as bigint) as length from lineitem)"""
    steps["control_any"] = f"select distinct {_SITE_ID} as id from counts_all where sample_type = 'endo'"
    unedged = "best_all"
    if control:
        steps["best_uncontrolled"] = "select * from best_all where id not in (select id from control_any)"
        unedged = "best_uncontrolled"
    if edge:
        steps["best_edged"] = f"""
select b.* from {unedged} b join genome_len using (chr)
where region_start > 100 and length - region_end > 100"""
        unedged = "best_edged"
    if filters:
        extra = -1 if control else 0
        steps["chunks"] = """
select chr, i as chunk,
       translate(md5(concat(chr, ':', cast(i as varchar))), '0123456789abcdef', 'ACGTACGTACGTACGT') as seq
from (select chr, unnest(range(0, cast(floor((length - 1) / 32.0) as bigint) + 1)) as i from genome_len)"""
        steps["genome"] = "select chr, string_agg(seq, '' order by chunk) as bases from chunks group by chr"
        steps["oligos"] = _OLIGOS
        steps["windows"] = f"""
select b.*, o.oligo_len, o.seq as oligo,
       case when strand = '+' then greatest(0, end5 - 1 - (oligo_len + {extra})) else end5 - 1 end as ws,
       case when strand = '+' then end5 else least(length, end5 + oligo_len + {extra}) end as we
from {unedged} b join genome_len l using (chr) join oligos o on o.library_method = b.library_method"""
        steps["window_seqs"] = """
select w.*, case when strand = '+' then substr(bases, cast(ws + 1 as bigint), cast(we - ws as bigint))
            else reverse(translate(substr(bases, cast(ws + 1 as bigint), cast(we - ws as bigint)), 'ACGT', 'TGCA')) end as seq
from windows w join genome using (chr)"""
        steps["identities"] = """
select *, case when length(seq) >= length(oligo) then
  (select count(*) from range(1, length(oligo) + 1) t(i)
   where substr(oligo, cast(i as bigint), 1) = substr(seq, cast(i as bigint), 1)) end as identical_base_num
from window_seqs"""
        steps["best"] = f"""
select * from {unedged} where id in (
  select id from identities where oligo_len = 4 and identical_base_num < 4
  intersect select id from identities where oligo_len = 10 and identical_base_num < 8)"""
    else:
        steps["best"] = f"select * from {unedged}"
    steps["best_unit"] = 'select *, end5 - 1 as "start", end5 as "end" from best'
    steps["pair_sites"] = "select * from best_unit where library_method in ('TA', 'TC')"
    steps["pair_islands"] = _islands("pair_sites", "species, chr, strand", 5)
    steps["pair_regions"] = """
select species, chr, strand, region, min("start") as "start", max("end") as "end",
       count(distinct library_method) as n_methods
from pair_islands group by all"""
    steps["pair_best"] = f"""
select * exclude (rn) from (
  select *, row_number() over (partition by species, chr, strand, region, library_method order by {_CPM_ORDER}) as rn
  from pair_islands) where rn = 1"""
    steps["pair_combined"] = """
select b.species, b.chr, b.strand, min(end5) - 1 as "start", max(end5) as "end",
       string_agg(id, ',' order by library_method) as id, b.region
from pair_best b join pair_regions r
  on b.species = r.species and b.chr = r.chr and b.strand = r.strand and b.region = r.region
where n_methods = 2 group by b.species, b.chr, b.strand, b.region"""
    steps["pair_single"] = """
select i.species, i.chr, i.strand, r."start", r."end", string_agg(id, ',' order by id) as id, i.region
from pair_islands i join pair_regions r
  on i.species = r.species and i.chr = r.chr and i.strand = r.strand and i.region = r.region
where n_methods = 1 group by i.species, i.chr, i.strand, r."start", r."end", i.region"""
    others = _in_list(m for m in methods if m not in ("TA", "TC"))
    steps["final_parts"] = f"""
select species, chr, strand, "start", "end", id, end5, library_method, cpm_end5_mean from best_unit
where library_method in ({others})
union all
select u.species, u.chr, u.strand, u."start", u."end", s.id, s.end5, s.library_method, s.cpm_end5_mean
from (select * exclude (region), unnest(string_split(id, ',')) as one from (
        select * from pair_combined union all select * from pair_single)) u
join best s on s.id = u.one"""
    steps["final_islands"] = _islands("final_parts", "species, chr, strand", 0)
    steps["long_all"] = f"""
select * exclude (rn) from (
  select *, row_number() over (partition by species, chr, strand, region, library_method order by {_CPM_ORDER}) as rn
  from final_islands) where rn = 1"""
    steps["region_bounds"] = """
select species, chr, strand, region, min("start") as "start", max("end") as "end"
from final_islands group by all"""
    steps["long"] = """
select l.species, l.chr, l.strand, b."start", b."end", l.library_method, l.end5, l.cpm_end5_mean, l.id
from long_all l join region_bounds b
  on l.species = b.species and l.chr = b.chr and l.strand = b.strand and l.region = b.region"""
    steps["tiered"] = f"""
select *, concat(species, '|', chr, '|', cast(t_start + 1 as varchar), '|', strand) as peak_id from (
  select *, {tiers} as tier from (
    select *, count(*) over w as n, min(end5) over w - 1 as t_start, max(end5) over w as t_end
    from long window w as (partition by species, chr, strand, "start", "end")))
where tier is not null"""
    return steps


_OLIGOS = """
select * from (values
  ('L1', 4, 'ACGT'), ('L1', 10, 'ACGTTGCAAC'), ('L2', 4, 'TTGA'), ('L2', 10, 'TTGACCGTAA'),
  ('TA', 4, 'AAAA'), ('TA', 10, 'AAAAAAAAAA'), ('TC', 4, 'CCCC'), ('TC', 10, 'CCCCCCCCCC')
) v(library_method, oligo_len, seq)"""


def with_ratios(steps: dict[str, str], grid=((100, True),), tiered: str = "tiered") -> dict[str, str]:
    """Steps of the site ratio and its means, for each (offset, upstream only)."""
    steps = dict(steps)
    reach = max(o for o, _ in grid) + 2
    steps["pairs"] = f"""
select t.tier, t.peak_id, t.species, t.chr, t.strand, t.library_method, t.end5 as peak, t.t_start,
       c.sample, c.sample_rep, c.sample_type, c.end5, c.count_end5, abs(c.end5 - t.end5) as d,
       case when t.strand = '+' then c.end5 - t.end5 else t.end5 - c.end5 end as rel
from {tiered} t join counts c
  on c.species = t.species and c.library_method = t.library_method and c.chr = t.chr and c.strand = t.strand
     and c.end5 between t.end5 - {reach} and t.end5 + {reach}"""
    parts = []
    for offset, upstream in grid:
        tag = f"{'u' if upstream else 'ud'}_{offset}"
        up = "and rel <= 0" if upstream else ""
        parts.append(f"""
select tier, peak_id, species, chr, strand, library_method, peak, t_start, sample, sample_rep, sample_type,
       '{tag}' as ratio_type,
       cast(coalesce(sum(case when d = 0 then count_end5 end), 0) as bigint) as cs,
       cast(coalesce(sum(case when d > 0 then count_end5 end), 0) as bigint) as other
from pairs where d <= {offset + 2} and d not between 1 and 2 {up} group by all""")
    steps["ratios"] = (
        "select *, cs / (1.0::double + other) as ratio from (" + "\nunion all\n".join(parts) + ")"
    )
    steps["rep_means"] = """
select tier, peak_id, ratio_type, r.library_method, sample_rep, sum(ratio) / max(n_type) as v, max(n_rep) as n_rep
from ratios r join design d on r.library_method = d.library_method group by all"""
    steps["method_means"] = """
select tier, peak_id, ratio_type, library_method, sum(v) / max(n_rep) as v from rep_means group by all"""
    steps["peak_means"] = """
select tier, peak_id, ratio_type, sum(v) / 4 as ratio_mean from method_means group by all"""
    return steps


def sql(steps: dict[str, str], final: str) -> str:
    ctes = ",\n".join(f"{name} as ({body.strip()})" for name, body in steps.items())
    return f"with {ctes}\n{final.strip()}"


_THREE = dict(
    methods=("L1", "TA", "TC"), control=True, tiers="case when n >= 3 then 't0' when n = 2 then 't1' end"
)
_GRID = ((50, True), (100, True), (50, False), (100, False))
_TAGS = tuple(f"{'u' if up else 'ud'}_{offset}" for offset, up in _GRID)
_FOUR_METHODS = ("L1", "L2", "TA", "TC")
_HOT = """
(chr = 'chr2' and coor_per > 0.875) or (chr = 'chr4' and coor_per between 0.375 and 0.5)
or (chr = 'chr5' and coor_per < 0.03)"""
_RATIO_COLUMNS = (
    "tier, peak_id, species, library_method, chr, strand, peak, sample, ratio_type, cs, other, round(ratio, 6) as ratio"
)
_POSITIONS = """
select t.*, (t_start + 1)::double / length as coor_per from tiered t left join genome_len g on g.chr = t.chr"""


_SHORT = "case chr when 'chr1' then 'c1' when 'chr2' then 'c2' when 'chr3' then 'c3' else chr end"
_UCSC = "case chr when 'chr1' then 'chr11' when 'chr2' then 'chr12' when 'chr3' then 'chrX' when 'chr4' then 'chr14' else chr end"


def _info_sql(methods, alias: str = "") -> str:
    peaks = ", ".join(f"max(case when library_method = '{m}' then peak end) as peak_{m}" for m in methods)
    names = ", ".join(f"peak_{m}" for m in methods)
    ucsc = f"{alias} as chr_UCSC," if alias else ""
    return f"""
select p.tier, p.peak_id, p.species, p.chr, {ucsc} p.strand, {names}, round(ratio_mean, 6) as ratio_u_100
from (select tier, peak_id, species, chr, strand, {peaks} from ratios group by all) p
left join peak_means m on m.peak_id = p.peak_id"""


def _outside_hotspots(steps: dict[str, str]) -> dict[str, str]:
    steps = dict(steps)
    steps["positions"] = _POSITIONS
    steps["cool"] = f"select * from positions where peak_id not in (select peak_id from positions where {_HOT})"
    return steps


def _near_start(steps: dict[str, str]) -> dict[str, str]:
    """Sites 195 bases nearer to the start of their contig."""
    moved = {}
    for name, body in steps.items():
        moved[name] = body.replace("from best_all b join genome_len l", "from near b join genome_len l") if name == "windows" else body
        if name == "best_all":
            moved["near"] = "select * exclude (end5), end5 - 195 as end5 from best_all"
    return moved


_TRUNCATED = """
select cast(oligo_len as bigint) as oligo_len, cast(sum(case when length(seq) < oligo_len then 1 else 0 end) as bigint) as n_truncated,
       count(*) as n_sites, (select count(*) from best) as n_kept
from window_seqs group by oligo_len"""

_KNOWN_SQL = f"""
select * from (select distinct tier, peak_id, r.sample, library_method, sample_rep, sample_type, cs,
round(cs * 1e6 / count_frag_sample, 6) as cpm from ratios r join sizes z on z.sample = r.sample
where peak_id in ({_in_list(KNOWN)}))"""


def oracle_sql() -> dict[str, str]:
    four = pipeline()
    counted = with_ratios(four)
    grid = with_ratios(four, _GRID)
    seq = pipeline(filters="identity")
    three = pipeline(**_THREE)
    three_counted = with_ratios(three)
    hot = dict(counted)
    hot["positions"] = _POSITIONS
    full = with_ratios(_outside_hotspots(seq), tiered="cool")
    three_full = with_ratios(_outside_hotspots(pipeline(filters="identity", edge=True, **_THREE)), tiered="cool")
    all_rows = "best_all"
    info_cpm = "round(cpm_end5_mean, 6) as cpm_end5_mean"
    count_columns = "species, sample, library_method, sample_rep, sample_type, chr, strand, end5, count_end5"

    def windows(n: int) -> dict[str, str]:
        steps = dict(seq)
        steps["w"] = f"""
select b.id, strand, chr, case when strand = '+' then greatest(0, end5 - 1 - {n}) else end5 - 1 end as "start",
       case when strand = '+' then end5 else least(length, end5 + {n}) end as "end"
from best_all b join genome_len using (chr)"""
        steps["ws"] = """
select w.*, case when strand = '+' then substr(bases, cast("start" + 1 as bigint), cast("end" - "start" as bigint))
            else reverse(translate(substr(bases, cast("start" + 1 as bigint), cast("end" - "start" as bigint)), 'ACGT', 'TGCA')) end as seq
from w join genome using (chr)"""
        return steps

    wide = dict(four)
    wide["wide_islands"] = _islands("sites", "species, library_method, chr, strand", 60)
    wide["wide_regions"] = """
select species, library_method, chr, strand, region, min("start") as region_start, max("end") as region_end
from wide_islands group by all"""
    two = pipeline(two=True)
    two_full = with_ratios(_outside_hotspots(pipeline(filters="identity", two=True)), tiered="cool")
    three_two = pipeline(two=True, **_THREE)
    lists = dict(four)
    lists["members"] = """
select r.species, r.library_method, r.chr, r.strand, region_start, region_end, s.id, s."start"
from site_islands s join regions r
  on s.species = r.species and s.library_method = r.library_method and s.chr = r.chr and s.strand = r.strand
     and s.region = r.region"""
    frag = {"frags": four["frags"]}
    frag["f"] = "select *, 0 as end5, '' as library_method from frags"
    frag["fi"] = _islands("f", "sample, chr, strand", 0)

    best_columns = f"select species, library_method, chr, strand, region_start, region_end, end5, {info_cpm}, id from {all_rows}"

    def spike_sql(species: str) -> str:
        return f"""select {species} as species, s.sample, split_part(s.sample, '|', 2) as library_method,
            split_part(s.sample, '|', 3) as sample_rep, split_part(s.sample, '|', 4) as sample_type, chr, strand, end5,
            count_end5, count_frag_sample, round(count_end5 * 1e6 / count_frag_sample, 6) as cpm_end5
            from (select sample, chr, strand, case when strand = '+' then "start" + 1 else "end" end as end5,
                  cast(sum(count_frag) as bigint) as count_end5 from spike where type <> 'capped' group by all) s
            left join sizes z on z.sample = s.sample"""

    two_species = "case split_part(s.sample, '|', 1) when 'A1' then 'spA' else 'spB' end"
    return {
        "library_sizes_2s": sql(two, "select * from sizes"),
        "design_numbers_2s": sql(
            two,
            """select case split_part(sample, '|', 1) when 'A1' then 'spA' else 'spB' end as species,
            split_part(sample, '|', 2) as library_method, count(distinct split_part(sample, '|', 3)) as n_rep,
            count(distinct split_part(sample, '|', 4)) as n_type from sizes group by 1, 2""",
        ),
        "end5_counts_2s": sql(two, f"select {count_columns} from counts_all"),
        "end5_counts_grid_2s": sql(two, f"select {count_columns} from counts"),
        "spikein_cpm_2s": sql(two, spike_sql(two_species)),
        "region_best_site_2s": sql(two, best_columns),
        "background_all_2s": sql(
            three_two,
            f"""select {_SITE_ID} as site_id from counts_all where sample_type = 'endo'
            group by species, library_method, chr, strand, end5
            having count(*) >= 3""",
        ),
        "tier_info_2s": sql(with_ratios(two), _info_sql(_FOUR_METHODS)),
        "tier_info_multi": sql(two_full, _info_sql(_FOUR_METHODS)),
        "tier_info_multi_ucsc": sql(two_full, _info_sql(_FOUR_METHODS, _UCSC)),
        "tier_info_from_sheet": sql(counted, _info_sql(_FOUR_METHODS)),
        "sheet_files": sql(
            four,
            """select kind, sample, count(*) as n_rows, cast(sum(count_frag) as bigint) as count_frag, true as has_files
            from (select 'genome' as kind, * from frags union all select 'spikeins', * from spike) group by kind, sample""",
        ),
        "cleavage_ratio_bucketed": sql(counted, f"select {_RATIO_COLUMNS} from ratios"),
        "known_sites_full": sql(with_ratios(seq), _KNOWN_SQL),
        "position_contingency": sql(
            hot, "select chr, cast(least(floor(coor_per * 40), 39) as bigint) as part, count(*) as n from positions group by 1, 2"
        ),
        "truncated_windows": sql(_near_start(seq), _TRUNCATED),
        "bed_order": sql(
            four,
            """select id, row_number() over (order by concat(species, '|', library_method, '|', chr), end5, id) as rank,
            true as in_order, true as after_previous from best_all""",
        ),
        "report_order": sql(
            counted,
            """select peak_id, sample, row_number() over (order by peak_id, sample) as rank, true as in_order, true as after_previous
            from ratios group by peak_id, sample""",
        ),
        "split_order": sql(
            four, "select library_method, count(*) as n_rows, true as in_order, true as after_previous from best_all group by 1"
        ),
        "tier_info_3m_2s": sql(with_ratios(three_two), _info_sql(_THREE["methods"])),
        "library_sizes": sql(four, "select * from sizes"),
        "design_numbers": sql(
            four,
            "select 'spA' as species, library_method, n_rep, n_type from design",
        ),
        "fragment_ends": sql(
            four,
            """select sample, chr, case when strand = '+' then "start" + 1 else "end" end as end5,
            case when strand = '+' then "end" else "start" + 1 end as end3, strand, type, count_frag from frags""",
        ),
        "end5_counts_by_type": sql(
            four,
            """select sample, chr, strand, type, case when strand = '+' then "start" + 1 else "end" end as end5,
            cast(sum(count_frag) as bigint) as count_end5 from frags group by all""",
        ),
        "end5_counts": sql(four, f"select {count_columns} from counts_all"),
        "end5_counts_main_contigs": sql(
            four, f"select {count_columns} from counts_all where chr in ('chr2', 'chr3', 'chr4')"
        ),
        "spikein_cpm": sql(
            four,
            """select 'spA' as species, s.sample, split_part(s.sample, '|', 2) as library_method,
            split_part(s.sample, '|', 3) as sample_rep, split_part(s.sample, '|', 4) as sample_type, chr, strand, end5,
            count_end5, count_frag_sample, round(count_end5 * 1e6 / count_frag_sample, 6) as cpm_end5
            from (select sample, chr, strand, case when strand = '+' then "start" + 1 else "end" end as end5,
                  cast(sum(count_frag) as bigint) as count_end5 from spike where type <> 'capped' group by all) s
            left join sizes z on z.sample = s.sample""",
        ),
        "samples_without_size": sql(
            four, "select distinct sample from counts_all where sample not in (select sample from sizes where sample <> 'spA|TA|r2|N')"
        ),
        "reproducible_sites": sql(
            four,
            """select species, library_method, chr, strand, end5, sample_rep, round(cpm_end5_sum, 6) as cpm_end5_sum
            from hits""",
        ),
        "site_means": sql(
            four,
            f"""select concat(species, '|', library_method, '|', chr) as chrom, "start", "end", id, {info_cpm}, strand
            from sites""",
        ),
        "merge_d5_regions": sql(
            four,
            """select species, library_method, chr, strand, region_start as "start", region_end as "end", n_sites
            from regions""",
        ),
        "merge_d5_members": sql(
            lists, "select species, library_method, chr, strand, region_start, region_end, id from members"
        ),
        "merge_d5_id_lists": sql(
            lists,
            """select species, library_method, chr, strand, region_start, region_end, id,
            count(*) over (partition by species, library_method, chr, strand, region_start) as n_ids from members""",
        ),
        "merge_d60_members": sql(
            wide,
            """select i.species, i.library_method, i.chr, i.strand, region_start, region_end, id
            from wide_islands i join wide_regions r
            on i.species = r.species and i.library_method = r.library_method and i.chr = r.chr and i.strand = r.strand
            and i.region = r.region""",
        ),
        "sample_crosstab": sql(
            four,
            """select library_method, sample_type, count(*) as n from (select distinct split_part(sample, '|', 2) as library_method,
            split_part(sample, '|', 3) as sample_rep, split_part(sample, '|', 4) as sample_type from sizes) group by 1, 2""",
        ),
        "lengths_roundtrip": sql(four, "select chr, cast(length as bigint) as length from genome_len"),
        "genome_roundtrip": sql(
            seq,
            """select chr, i as chunk, substr(bases, cast(96 * i + 1 as bigint), 96) as seq
            from (select chr, bases, unnest(range(0, cast(ceil(length(bases) / 96.0) as bigint))) as i from genome)""",
        ),
        "report_roundtrip": sql(counted, _KNOWN_SQL + " cross join (values ('csv'), ('parquet')) f(form)"),
        "fragment_islands": sql(
            frag,
            """select sample, chr, strand, min("start") as "start", max("end") as "end", count(*) as n_fragments,
            cast(sum(count_frag) as bigint) as count_frag from fi group by sample, chr, strand, region""",
        ),
        "region_best_site": sql(
            four,
            f"select species, library_method, chr, strand, region_start, region_end, end5, {info_cpm}, id from {all_rows}",
        ),
        "site_windows": sql(windows(250), 'select id, strand, "start", "end" from w'),
        "site_id_parts": sql(
            four,
            """select id, species, chr, strand, end5, library_method, chr as contig_chr, library_method as last,
            cast(null as varchar) as absent from best_all""",
        ),
        "tailing_merged": sql(
            four,
            """select species, chr, strand, min("start") as "start", max("end") as "end", count(*) as n_sites
            from pair_islands group by species, chr, strand, region""",
        ),
        "tailing_combined": sql(
            four, """select species, chr, strand, "start", "end", id, '.' as score from pair_combined"""
        ),
        "tailing_single": sql(
            four, """select species, chr, strand, "start", "end", id, '.' as score from pair_single"""
        ),
        "methods_merged_long": sql(
            four, f"""select species, chr, strand, "start", "end", library_method, end5, {info_cpm}, id from long"""
        ),
        "tier_peaks": sql(
            four,
            f"""select species, chr, strand, tier, t_start as "start", t_end as "end", peak_id, library_method,
            end5 as peak, {info_cpm} from tiered""",
        ),
        "tier_region_bounds": sql(
            four, """select distinct tier, peak_id, t_start as "start", t_end as "end" from tiered"""
        ),
        "tier_by_method": sql(
            four,
            "select tier, library_method, count(*) as n from tiered group by tier, library_method",
        ),
        "window_regions": sql(
            four,
            """select concat(peak_id, '%', cast(end5 as varchar)) as region_id, end5 - 102 as region_start,
            end5 + 102 as region_end, species, library_method, chr, strand from tiered""",
        ),
        "range_join_window": sql(
            counted, "select peak_id, peak, library_method, sample, end5, count_end5, rel as rel_coor from pairs"
        ),
        "cleavage_ratio_u100": sql(counted, f"select {_RATIO_COLUMNS} from ratios"),
        "cleavage_ratio_grid": sql(grid, f"select {_RATIO_COLUMNS} from ratios"),
        "ratio_hier_mean": sql(
            grid, "select tier, peak_id, ratio_type, round(ratio_mean, 6) as ratio_mean from peak_means"
        ),
        "ratio_pivot": sql(
            grid,
            "select tier, peak_id, "
            + ", ".join(
                f"round(max(case when ratio_type = '{t}' then ratio_mean end), 6) as ratio_{t}" for t in _TAGS
            )
            + " from peak_means group by tier, peak_id",
        ),
        "peak_pivot": sql(
            counted,
            "select tier, peak_id, species, chr, strand, "
            + ", ".join(f"max(case when library_method = '{m}' then peak end) as peak_{m}" for m in _FOUR_METHODS)
            + " from ratios group by all",
        ),
        "tier_info": sql(counted, _info_sql(_FOUR_METHODS)),
        "alias_recode": sql(counted, _info_sql(_FOUR_METHODS, _SHORT)),
        "genome_chunks": sql(seq, "select * from chunks"),
        "upstream_seq_incl": sql(windows(10), 'select id, "start", "end", seq from ws'),
        "upstream_seq_indexed": sql(windows(10), 'select id, "start", "end", seq from ws'),
        "upstream_seq_blocks": sql(windows(10), 'select id, "start", "end", seq from ws'),
        "upstream_seq_excl": sql(windows(9), 'select id, "start", "end", seq from ws'),
        "oligo_identity": sql(seq, "select id, cast(oligo_len as bigint) as oligo_len, identical_base_num from identities"),
        "identity_intersect": sql(seq, "select id from best"),
        "mispriming_filter": sql(seq, "select id from best"),
        "fasta_roundtrip": sql(windows(10), "select id, cast(0 as bigint) as chunk, seq from ws"),
        "contig_edge": sql(
            four,
            """select id, region_start, region_end from best_all b join genome_len using (chr)
            where region_start > 300 and length - region_end > 300""",
        ),
        "hotspot_peaks": sql(hot, f"select distinct peak_id from positions where {_HOT}"),
        "hotspot_anti": sql(
            hot,
            f"select {_RATIO_COLUMNS} from ratios where peak_id not in (select peak_id from positions where {_HOT})",
        ),
        "position_ecdf": sql(
            hot,
            """select distinct species, chr, library_method, round(coor_per, 6) as coor_per, round(ecdf, 6) as ecdf
            from (select *, cume_dist() over (partition by species, chr, library_method order by coor_per) as ecdf
                  from positions)""",
        ),
        "known_sites": sql(
            counted,
            _KNOWN_SQL,
        ),
        "tier_info_full": sql(full, _info_sql(_FOUR_METHODS)),
        "partition_roundtrip": sql(four, f"select {count_columns} from counts_all"),
        "bed_roundtrip": sql(
            four,
            f"""select concat(species, '|', library_method, '|', chr) as chrom, "start", "end", id, {info_cpm}, strand
            from sites""",
        ),
        "fragment_roundtrip": sql(four, "select * from frags"),
        "merged_bed_roundtrip": sql(
            lists,
            """select concat(species, '|', library_method, '|', chr) as chr, region_start as "start",
            region_end as "end", strand, id from members""",
        ),
        "tsv_roundtrip": sql(
            four, """select distinct tier, peak_id, t_start as "start", t_end as "end" from tiered"""
        ),
        "split_by_method": sql(
            four, """select chr, end5 - 1 as "start", end5 as "end", strand, library_method from best_all"""
        ),
        "background_any": sql(three, "select id as site_id from control_any"),
        "background_all": sql(
            three,
            f"""select {_SITE_ID} as site_id from counts_all where sample_type = 'endo'
            group by species, chr, strand, end5, library_method having count(*) >= 3""",
        ),
        "background_filtered": sql(
            three,
            f"select species, library_method, chr, strand, region_start, region_end, end5, {info_cpm}, id from best",
        ),
        "region_best_site_3m": sql(
            three,
            f"select species, library_method, chr, strand, region_start, region_end, end5, {info_cpm}, id from best",
        ),
        "reproducible_sites_3m": sql(
            three,
            """select species, library_method, chr, strand, end5, sample_rep, round(cpm_end5_sum, 6) as cpm_end5_sum
            from hits""",
        ),
        "cleavage_ratio_3m": sql(three_counted, f"select {_RATIO_COLUMNS} from ratios"),
        "tier_info_3m": sql(three_counted, _info_sql(_THREE["methods"])),
        "tier_info_3m_full": sql(three_full, _info_sql(_THREE["methods"])),
    }

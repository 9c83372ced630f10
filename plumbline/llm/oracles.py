"""SQL of the operators that SQL can express, written from their contracts: direct and without hashes."""

from __future__ import annotations

import math

_WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
_A_TO_Z = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Runs of removed places from the starts in ``gone`` (doc_id, s), each covering {n} places.
_SPANS = """marked as (select doc_id, s, lag(s) over (partition by doc_id order by s) as p from gone),
 grouped as (select doc_id, s, sum(case when s <= p + {n} then 0 else 1 end) over (partition by doc_id order by s) as g from marked),
 spans as (select doc_id, min(s) as a, max(s) + {n} as b from grouped group by doc_id, g),
 gaps as (select doc_id, a, b, coalesce(lag(b) over (partition by doc_id order by a), 0) as kept_from from spans)"""

SUFFIX_DEDUP = f"""with d as (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
 w as (select doc_id, s, substring(h, 2 * s + 1, 200) as b from d, lateral (select unnest(range(0, length(h) // 2 - 99)) as s)),
 gone as (select doc_id, s from w qualify row_number() over (partition by b order by doc_id, s) > 1),
 {_SPANS.format(n=100)},
 cut as (select doc_id, count(*) as n_spans, sum(b - a) as n_removed, max(b) as last, string_agg(substring(h, 2 * kept_from + 1, 2 * (a - kept_from)), '' order by a) as head from gaps join d using (doc_id) group by doc_id)
 select doc_id, (length(h) // 2)::bigint as n_bytes, coalesce(n_removed, 0)::bigint as n_removed, coalesce(n_spans, 0)::bigint as n_spans,
 sha256(unhex(coalesce(head || substring(h, 2 * last + 1), h))) as kept_sha256 from d left join cut using (doc_id)"""

SUBSTRING_DEDUP = f"""with d as (select doc_id, {_WORDS.format("text")} as w from documents),
 r as (select doc_id, s, array_to_string(w[s + 1 : s + 35], ' ') as b from d, lateral (select unnest(range(0, len(w) - 34)) as s)),
 gone as (select doc_id, s from r qualify count(*) over (partition by b) > 1),
 {_SPANS.format(n=35)},
 cut as (select doc_id, sum(b - a) as n_removed, max(b) as last, flatten(list(w[kept_from + 1 : a] order by a)) as head from gaps join d using (doc_id) group by doc_id)
 select doc_id, len(w)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed,
 sha256(array_to_string(case when last is null then w else list_concat(head, w[last + 1 :]) end, ' ')) as kept_sha256 from d left join cut using (doc_id)"""

DECONTAMINATION = f"""with d as (select doc_id, {_WORDS.format("lower(text)")} as w from documents), i as (select item_id, {_WORDS.format("lower(text)")} as w from benchmark),
 dw as (select doc_id, unnest(w) as word, unnest(range(0, len(w))) as p, len(w) as nd from d), iw as (select item_id, unnest(w) as word, unnest(range(0, len(w))) as q, len(w) as n from i where len(w) >= 5),
 same as (select doc_id, item_id, p - q as off, q, n, nd from dw join iw using (word)),
 lines as (select doc_id, item_id, off, any_value(n) as n, any_value(nd) as nd, list(q) as qs from same group by all having count(*) >= least(10, any_value(n))),
 alone as (select doc_id, item_id, len(i.w) as n, len(i.w) as n_equal, len(i.w) as best_window, 0 as doc_start from d join i on d.w = i.w where len(i.w) between 1 and 4),
 best as (select *, len(qs) as n_equal, case when n >= 12 then list_max(list_transform(range(greatest(0, -off), least(n, nd - off) - 11), lambda s: len(list_filter(qs, lambda q: q >= s and q < s + 12)))) else len(qs) end as best_window from lines)
 select doc_id, item_id, n as n_item_words, n_equal, best_window, doc_start from (select doc_id, item_id, n, n_equal, best_window, off as doc_start from best where case when n >= 12 then best_window >= 10 else n_equal = n end union all select * from alone)
 qualify row_number() over (partition by doc_id, item_id order by n_equal desc, best_window desc, doc_start) = 1"""

NEAR_DEDUP = f"""with recursive d as (select doc_id, {_WORDS.format(_A_TO_Z.format("text"))} as w from documents),
 s as (select doc_id, case when len(w) >= 5 then list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' '))) when len(w) > 0 then [array_to_string(w, ' ')] else [] end as shingles from d),
 x as (select doc_id, len(shingles) as n, unnest(shingles) as shingle from s),
 pairs as (select a.doc_id as u, b.doc_id as v from x a join x b on a.shingle = b.shingle and a.doc_id < b.doc_id group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 85 * (a.n + b.n - count(*))),
 links as (select u, v from pairs union all select v, u from pairs),
 reach as (select doc_id as node, doc_id as root from s union select links.u, reach.root from links join reach on links.v = reach.node)
 select s.doc_id, len(shingles)::bigint as n_shingles, min(root) as component_id, s.doc_id = min(root) as kept from s join reach on s.doc_id = reach.node group by s.doc_id, shingles"""


#: Least standard deviations of the five statistics, as op4 states them.
LEAST = [0.1, 0.04, 0.15, 0.12, 1.5]
P = len(LEAST)


def _chi_square(x: float, k: int) -> float:
    """The distribution function for an odd number of degrees of freedom, in closed form."""
    tail, term = 0.0, 1.0
    for r in range(1, k - 1, 2):
        term *= x / r if r > 1 else math.sqrt(x)
        tail += term
    return math.erf(math.sqrt(x / 2)) - math.sqrt(2 / math.pi) * math.exp(-x / 2) * tail


def _quantile(p: float, k: int) -> float:
    x, step = 0.0, 64.0
    while step > 1e-13:
        x += step if _chi_square(x + step, k) < p else 0.0
        step /= 2
    return x


def quality_rules(steps: int = 3, keep: float = 0.75, tail: float = 1e-6, min_rows: int = 50) -> str:
    """The base statistics and the minimum-covariance-determinant verdict as one chain of table expressions."""
    least = LEAST
    inside, near = _quantile(keep, P), _quantile(0.975, P)
    lower = [(i, j) for i in range(P) for j in range(i + 1)]
    model = ", ".join([f"m{i}" for i in range(P)] + [f"l{i}{j}" for i, j in lower])

    def distance(i: int) -> str:
        return f"(x{i} - m{i}" + "".join(f" - l{i}{j} * y{j}" for j in range(i)) + f") / l{i}{i} as y{i}"

    far = ", ".join(distance(i) for i in range(P)) + ", " + " + ".join(f"y{i} * y{i}" for i in range(P)) + " as d2"

    def factor(i: int, j: int, scale: float) -> str:
        c = f"(p{i}{j} - a{i} * a{j}) * {scale!r}"
        if i != j:
            return f"({c}" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) + f") / l{j}{j} as l{i}{j}"
        return f"sqrt(greatest(greatest({c}, {least[i] ** 2!r})" + "".join(f" - l{i}{k} * l{i}{k}" for k in range(i)) + f", {(least[i] / 100) ** 2!r})) as l{i}{i}"

    def at_share(share: float, rows: str, value: str) -> str:
        """The first bin of each group up to which a share of its rows lies."""
        return f"""select g, min(bin) as bin from (select g, bin, sum(n) over (partition by g order by bin) as c, sum(n) over (partition by g) as total
  from (select g, {value} as bin, count(*) as n from {rows} group by all)) where c >= {share} * total group by g"""

    medians = ", ".join(f"med{i} as ({at_share(0.5, 'passed', f'floor(x{i} * 4 / {least[i]!r})')})" for i in range(P))
    start = ", ".join([f"(med{i}.bin + 0.5e0) * {least[i] / 4!r} as m{i}" for i in range(P)] + [f"{least[i] if i == j else 0.0!r}::double as l{i}{j}" for i, j in lower])
    chain = [medians, f"model0 as (select med0.g, {start} from med0 " + " ".join(f"join med{i} using (g)" for i in range(1, P)) + ")"]
    for k in range(steps + 1):
        last = k == steps
        scale = 0.975 / _chi_square(near, P + 2) if last else keep / _chi_square(inside, P + 2)
        chain.append(f"far{k} as (select *, floor(ln(d2 + 1e-6) * 20) as bin from (select *, {far} from passed join model{k} using (g)))")
        chain.append(f"cut{k} as ({at_share(keep, f'far{k}', 'bin')})")
        chosen = f"far{k} where d2 <= {near!r}" if last else f"far{k} f join cut{k} c using (g) where f.bin <= c.bin"
        sums = ", ".join([f"any_value(m{i}) as o{i}, avg(x{i} - m{i}) as a{i}" for i in range(P)] + [f"avg((x{i} - m{i}) * (x{j} - m{j})) as p{i}{j}" for i, j in lower])
        chain.append(f"sums{k} as (select g, {sums} from {chosen} group by g)")
        fresh = ", ".join([f"o{i} + a{i} as m{i}" for i in range(P)] + [factor(i, j, scale) for i, j in lower])
        chain.append(f"fresh{k} as (select g, {fresh} from sums{k})")
        chain.append(f"model{k + 1} as (select g, {model} from fresh{k} union all select g, {model} from model{k} where g not in (select g from fresh{k}))")
    return f"""with w as (select *, coalesce(text, '') as t, {_WORDS.format("text")} as w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as lines from documents),
 eight as (select doc_id, i, array_to_string(w[i + 1 : i + 8], ' ') as b from w, lateral (select unnest(range(0, len(w) - 7)) as i)),
 again as (select doc_id, i from eight qualify count(*) over (partition by doc_id, b) > 1),
 cover as (select doc_id, sum(least(8, coalesce(i - p, 8))) as n from (select *, lag(i) over (partition by doc_id order by i) as p from again) group by doc_id),
 base as (select doc_id, lang, source, len(w)::bigint as n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint as word_chars, (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint as n_dup_lines, len(lines) as n_lines, coalesce(n, 0)::bigint as n_repeat_words from w left join cover using (doc_id)),
 vectors as (select *, n_words < 20 or 100 * n_repeat_words > 30 * n_words as base_failed, ln(greatest(word_chars, 1)::double / greatest(n_words, 1)) as x0, sqrt(n_symbols::double / greatest(word_chars, 1)) as x1,
  sqrt(n_dup_lines::double / greatest(n_lines, 1)) as x2, sqrt(n_repeat_words::double / greatest(n_words, 1)) as x3, ln(greatest(n_words, 1)::double) as x4, concat(coalesce('=' || lang, '-'), chr(0), coalesce('=' || source, '-')) as k from base),
 large as (select k from vectors where not base_failed group by k having count(*) >= {min_rows}),
 placed as (select *, case when k in (select k from large) then k else '' end as g from vectors), passed as (select * from placed where not base_failed),
 {", ".join(chain)}
 select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and coalesce(d2 <= {_quantile(1 - tail, P)!r}, true) as kept, round(d2, 6) as outlier_distance
 from (select placed.*, {far.replace("x", "placed.x")} from placed left join model{steps + 1} using (g))"""


QUALITY_RULES = quality_rules()


def _tree(name: str, levels: int = 6) -> str:
    """Levels of the trees over ``name``_0 (g, i, n, d), each with what stands before and after a node in its run."""
    out = []
    for k in range(levels):
        run = "partition by g, i // 16 order by i rows between"
        out.append(f"""{name}_{k}s as (select *, coalesce(string_agg(d, '') over ({run} unbounded preceding and 1 preceding), '') as b,
 coalesce(string_agg(d, '') over ({run} 1 following and unbounded following), '') as a from {name}_{k}),
{name}_{k + 1} as (select g, i // 16 as i, (n + 15) // 16 as n, case when n = 1 then min(d) else sha256(string_agg(d, '' order by i)) end as d from {name}_{k} group by g, i // 16, n)""")
    return ",\n".join(out)


def _walk(name: str, tree: str, levels: int = 6) -> str:
    """From ``name``_0 (r, g, i, cur, sib, ..) up: the digest so far and all siblings so far."""
    return ",\n".join(
        f"""{name}_{k + 1} as (select w.* replace (w.i // 16 as i, case when n = 1 then cur else sha256(b || cur || a) end as cur, sib || b || a as sib)
 from {name}_{k} w join {tree}_{k}s using (g, i))"""
        for k in range(levels)
    )


def merkle_manifest() -> str:
    """Six levels over rows and six over sources, unrolled: for up to 16 ** 6 rows of a source."""
    said = lambda c: f"case when {c} is null then '-' else octet_length(encode({c}::varchar)) || ':' || {c}::varchar end"
    fields = ["doc_id", "source", "lang", "n_chars"]
    digest = lambda text: f"sha256({' || '.join(map(said, fields))} || {said(text)})"
    bit = "case when y & 1 = 1 then xor(y >> 1, 3988292384::bigint) else y >> 1 end"
    codes = "list_transform(string_split(doc_id::varchar, ''), lambda c: ascii(c)::bigint)"
    crc = f"xor(list_reduce({codes}, lambda h, c: list_reduce(range(8), lambda y, j: {bit}, xor(h, c)), 4294967295::bigint), 4294967295::bigint)"
    lowered = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    return f"""with leaves as (select doc_id, case when source is null then '0' else '1' || source end as g, {digest("text")} as d, case when {crc} % 5 = 0 then {digest(lowered)} else {digest("text")} end as found from documents),
rows_0 as (select *, row_number() over (partition by g order by doc_id nulls first, d, found) - 1 as i, count(*) over (partition by g) as n, row_number() over () as r from leaves),
t_0 as (select g, i, n, d from rows_0), {_tree("t")},
groups as (select g as grp, d as subroot, row_number() over (order by g) - 1 as place, count(*) over () as n from t_6),
s_0 as (select '' as g, place as i, n, subroot as d from groups), {_tree("s")},
w_0 as (select r, doc_id, d as leaf, g, i, found as cur, '' as sib from rows_0), {_walk("w", "t")},
v_0 as (select r, doc_id, leaf, '' as g, place as i, cur, sib, subroot from w_6 join groups on g = grp), {_walk("v", "s")}
select doc_id, leaf, subroot, s_6.d as root, sha256(sib) as proof_sha256, cur as folded_root, cur = s_6.d as verified from v_6, s_6"""

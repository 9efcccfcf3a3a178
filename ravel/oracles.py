"""SQL for DuckDB of the catalogue's queries, as common table expressions that build on each other."""

from __future__ import annotations

_SEG = """
b AS (SELECT 'r' || o_orderkey AS read_id, (o_orderkey % 40) % 5 AS kind, 100000 + 50000 * (o_orderkey % 40) + o_custkey % 11 - 5 AS p, 400 + ((o_orderkey % 40) * 37) % 900 AS n,
  'chr' || ((o_orderkey % 40) % 3 + 1) AS c, 'chr' || ((o_orderkey % 40 + 1) % 3 + 1) AS cb, ((o_orderkey % 40) % 2 = 0 OR (o_orderkey // 40) % 3 <> 0) AS carrier, (o_orderkey // 80) % 2 = 1 AS minus FROM orders),
seg0 AS (
  SELECT read_id, 6000 + n AS read_len, 0 AS seg_idx, c AS chr, '+' AS strand, 0 AS rd_l, 5999 + n AS rd_r, p - 3000 AS rf_l, p + 2999 + n AS rf_r FROM b WHERE NOT carrier
  UNION ALL SELECT read_id, 6000, 0, c, CASE WHEN minus THEN '-' ELSE '+' END, CASE WHEN minus THEN 3000 ELSE 0 END, CASE WHEN minus THEN 5999 ELSE 2999 END, p - 2999, p FROM b WHERE carrier AND kind = 0
  UNION ALL SELECT read_id, 6000, 1, c, CASE WHEN minus THEN '-' ELSE '+' END, CASE WHEN minus THEN 0 ELSE 3000 END, CASE WHEN minus THEN 2999 ELSE 5999 END, p + n, p + n + 2999 FROM b WHERE carrier AND kind = 0
  UNION ALL SELECT read_id, 6000 + n, 0, c, '+', 0, 2999, p - 2999, p FROM b WHERE carrier AND kind = 1
  UNION ALL SELECT read_id, 6000 + n, 1, c, '+', 3000 + n, 5999 + n, p + 1, p + 3000 FROM b WHERE carrier AND kind = 1
  UNION ALL SELECT read_id, 6000 + n, 0, c, '+', 0, 2999, p - 2999, p FROM b WHERE carrier AND kind = 2
  UNION ALL SELECT read_id, 6000 + n, 1, c, '-', 3000, 2999 + n, p, p + n FROM b WHERE carrier AND kind = 2
  UNION ALL SELECT read_id, 6000 + n, 2, c, '+', 3000 + n, 5999 + n, p + n, p + n + 3000 FROM b WHERE carrier AND kind = 2
  UNION ALL SELECT read_id, 6500, 0, c, '+', 0, 2999, p + n - 2999, p + n FROM b WHERE carrier AND kind = 3
  UNION ALL SELECT read_id, 6500, 1, cb, '+', 3000, 3499, p, p + 499 FROM b WHERE carrier AND kind = 3
  UNION ALL SELECT read_id, 6500, 2, c, '+', 3500, 6499, p, p + 2999 FROM b WHERE carrier AND kind = 3
  UNION ALL SELECT read_id, 6000, 0, c, '+', 0, 2999, p - 2999, p FROM b WHERE carrier AND kind = 4
  UNION ALL SELECT read_id, 6000, 1, cb, '+', 3000, 5999, p + 7000, p + 9999 FROM b WHERE carrier AND kind = 4),
seg AS (SELECT read_id, CAST(read_len AS BIGINT) AS read_len, CAST(seg_idx AS BIGINT) AS seg_idx, chr, strand, CAST(rd_l AS BIGINT) AS rd_l, CAST(rd_r AS BIGINT) AS rd_r, CAST(rf_l AS BIGINT) AS rf_l, CAST(rf_r AS BIGINT) AS rf_r, CAST(rd_r + 1 - rd_l AS BIGINT) AS seg_len FROM seg0)"""

_LINES = """
seg AS (SELECT 'o' || l_orderkey AS read_id, CAST(20000 AS BIGINT) AS read_len, i AS seg_idx, 'chr' || (l_partkey % 2) AS chr, CASE WHEN l_suppkey % 4 = 0 THEN '-' ELSE '+' END AS strand, i * 1000 AS rd_l, i * 1000 + CAST(l_quantity AS BIGINT) * 20 AS rd_r,
  l_partkey * 97 + l_suppkey * 13 AS rf_l, l_partkey * 97 + l_suppkey * 13 + CAST(l_quantity AS BIGINT) * 20 AS rf_r, CAST(l_quantity AS BIGINT) * 20 + 1 AS seg_len
  FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS i FROM lineitem))"""

_NEAR = """
us AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY read_id) AS n0 FROM seg) WHERE n0 >= 2 AND seg_len >= 300),
nb AS (SELECT read_id, read_len, count(*) OVER (PARTITION BY read_id) AS n, row_number() OVER w - 1 AS i, chr AS c1, strand AS s1, rd_l AS rdl1, rd_r AS rdr1, rf_l AS rfl1, rf_r AS rfr1,
  lead(chr) OVER w AS c2, lead(strand) OVER w AS s2, lead(rd_l) OVER w AS rdl2, lead(rd_r) OVER w AS rdr2, lead(rf_l) OVER w AS rfl2, lead(rf_r) OVER w AS rfr2,
  lead(chr, 2) OVER w AS c3, lead(strand, 2) OVER w AS s3, lead(rd_l, 2) OVER w AS rdl3, lead(rd_r, 2) OVER w AS rdr3, lead(rf_l, 2) OVER w AS rfl3, lead(rf_r, 2) OVER w AS rfr3,
  lead(rd_l) OVER g AS rdla, lead(rd_r) OVER g AS rdra, lead(rf_l) OVER g AS rfla, lead(rf_r) OVER g AS rfra
  FROM us WINDOW w AS (PARTITION BY read_id ORDER BY rd_l, seg_idx), g AS (PARTITION BY read_id, chr, strand ORDER BY rd_l, seg_idx))"""

_PAIRS = """
cp0 AS (SELECT read_id, i, c1 AS chr, s1 AS strand, CASE WHEN s1 = '-' THEN read_len - rdl2 ELSE rdr1 END AS r1e, CASE WHEN s1 = '-' THEN read_len - rdr1 ELSE rdl2 END AS r2s, CASE WHEN s1 = '-' THEN rfr2 ELSE rfr1 END AS g1e, CASE WHEN s1 = '-' THEN rfl1 ELSE rfl2 END AS g2s FROM nb WHERE c1 = c2 AND s1 = s2),
cp AS (SELECT *, r2s - r1e AS gr, g2s - g1e AS gg, (r2s - r1e) - (g2s - g1e) AS d FROM cp0)"""

_INSP = """
insp AS (SELECT read_id, chr, strand, i, d AS len,
  CASE WHEN -gg >= 30 AND d <= 100000 THEN CASE WHEN r1e < r2s THEN CAST(g2s AS DOUBLE) WHEN gr > gg THEN (g2s + g1e) / 2.0 END WHEN -gg < 30 AND d >= 30 AND gg <= 200 AND d <= 100000 THEN CAST(CASE WHEN g1e < g2s THEN g1e ELSE g2s END AS DOUBLE) END AS pos,
  CASE WHEN -gg >= 30 AND d <= 100000 THEN CASE WHEN r1e < r2s THEN r1e + gg WHEN gr > gg THEN r1e + CAST(trunc(gg / 2.0) AS BIGINT) END WHEN -gg < 30 AND d >= 30 AND gg <= 200 AND d <= 100000 THEN CASE WHEN g1e < g2s THEN r1e ELSE r1e + gg END END AS q_start FROM cp)"""

_DELP = """
delp AS (SELECT read_id, chr, i, -d AS len, CASE WHEN -gg >= 30 AND d <= 100000 AND NOT (r1e < r2s) AND gr <= gg THEN (g2s + g1e) / 2.0 WHEN -gg < 30 AND -d >= 30 AND gr <= 200 AND -d <= 100000 THEN CAST(CASE WHEN r1e < r2s THEN g1e ELSE g1e + r2s - r1e - 1 END AS DOUBLE) END AS pos FROM cp)"""

_INV = """
ip AS (SELECT read_id, c1 AS chr, n, i, s1, rdr1 AS ra, rdl2 AS rb, CASE WHEN s1 = '+' THEN rfr1 ELSE rfl1 END AS x, CASE WHEN s1 = '+' THEN rfr2 ELSE rfl2 END AS y FROM nb WHERE n = 2 AND i = 0 AND c1 = c2 AND s1 <> s2
  UNION ALL SELECT read_id, c1, n, i, s2, rdr2, rdl3, CASE WHEN s2 = '+' THEN rfr2 ELSE rfl2 END, CASE WHEN s2 = '+' THEN rfr3 ELSE rfl3 END FROM nb WHERE n >= 3 AND c1 = c2 AND c2 = c3 AND s1 <> s3 AND s2 = s1
  UNION ALL SELECT read_id, c1, n, i, s1, rdr1, rdl2, CASE WHEN s1 = '+' THEN rfr1 ELSE rfl1 END, CASE WHEN s1 = '+' THEN rfr2 ELSE rfl2 END FROM nb WHERE n >= 3 AND c1 = c2 AND c2 = c3 AND s1 <> s3 AND s2 <> s1),
ipair AS (SELECT read_id, n, chr, CASE WHEN s1 = '+' THEN '++' ELSE '--' END AS orient, least(x, y) AS pos, greatest(x, y) AS pos2 FROM ip WHERE abs(x - y) >= 30 AND rb + 0.5 * abs(x - y) >= ra),
t3 AS (SELECT *, s2 = '-' AS fwd FROM nb WHERE n >= 3 AND c1 = c2 AND c2 = c3 AND s1 = s3 AND s1 <> s2),
t3k AS (SELECT * FROM t3 WHERE CASE WHEN fwd THEN rdl2 + 0.5 * (rfl3 - rfr1) >= rdr1 AND rdl3 + 0.5 * (rfl3 - rfr1) >= rdr2 ELSE rdl2 + 0.5 * (rfl1 - rfr3) >= rdr1 AND rdl3 + 0.5 * (rfl1 - rfr3) >= rdr2 END),
itri AS (SELECT read_id, c1 AS chr, '++' AS orient, CASE WHEN fwd THEN rfr1 ELSE rfr3 END AS pos, rfr2 AS pos2 FROM t3k UNION ALL SELECT read_id, c1, '--', rfl2, CASE WHEN fwd THEN rfl3 ELSE rfl1 END FROM t3k)"""

_TRA = """
tr0 AS (SELECT read_id, c1, c2, c1 < c2 AS less, s1 = '+' AS p, s2 = '+' AS q, CASE WHEN s1 = '+' THEN rfr1 ELSE rfl1 END AS x, CASE WHEN s2 = '+' THEN rfl2 ELSE rfr2 END AS y FROM nb WHERE c1 <> c2 AND rdl2 - rdr1 <= 100),
tra AS (SELECT read_id, least(c1, c2) AS chr, CASE WHEN p AND q THEN CASE WHEN less THEN 'A' ELSE 'D' END WHEN p THEN 'B' WHEN q THEN 'C' WHEN less THEN 'D' ELSE 'A' END AS orient, CASE WHEN less THEN x ELSE y END AS pos, greatest(c1, c2) AS chr2, CASE WHEN less THEN y ELSE x END AS pos2 FROM tr0)"""

_JUMP = """
j0 AS (SELECT read_id, c1 AS chr, s1 AS strand, i, CASE WHEN s1 = '-' THEN read_len - rdla ELSE rdr1 END AS r1e, CASE WHEN s1 = '-' THEN read_len - rdr1 ELSE rdla END AS r2s, CASE WHEN s1 = '-' THEN rfra ELSE rfr1 END AS g1e, CASE WHEN s1 = '-' THEN rfl1 ELSE rfla END AS g2s FROM nb WHERE n >= 3 AND c1 <> c2 AND rdla IS NOT NULL),
j1 AS (SELECT *, g2s - g1e AS dis_ref, r2s - r1e AS dis_read FROM j0),
jump AS (SELECT read_id, chr, strand, i, 'INS' AS kind, least(g2s, g1e) AS pos, dis_read - dis_ref AS len, r1e + CAST(trunc(dis_ref / 2.0) AS BIGINT) AS q_start, CAST(NULL AS BIGINT) AS pos2 FROM j1 WHERE dis_ref < 100 AND dis_read - dis_ref >= 30 AND dis_read - dis_ref <= 100000
  UNION ALL SELECT read_id, chr, strand, i, 'DUP', g2s, NULL, NULL, g1e FROM j1 WHERE dis_ref <= -30)"""

_MERGE_INS = """
im0 AS (SELECT read_id, chr, strand, 0 AS src, i, pos, len, q_start FROM insp WHERE pos IS NOT NULL UNION ALL SELECT read_id, chr, strand, 1, i, CAST(pos AS DOUBLE), len, q_start FROM jump WHERE kind = 'INS'),
im1 AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 100 AND strand = lag(strand) OVER w THEN 0 ELSE 1 END AS brk FROM im0 WINDOW w AS (PARTITION BY read_id, chr ORDER BY pos, src, i)),
im2 AS (SELECT *, sum(brk) OVER (PARTITION BY read_id, chr ORDER BY pos, src, i ROWS UNBOUNDED PRECEDING) AS isl, row_number() OVER (PARTITION BY read_id, chr ORDER BY pos, src, i) AS k FROM im1),
insm AS (SELECT read_id, chr, min(strand) AS strand, CAST(trunc((min(pos) + max(pos)) / 2) AS BIGINT) AS pos, CAST(sum(len) AS BIGINT) AS len, arg_min(q_start, k) AS q_start FROM im2 GROUP BY read_id, chr, isl)"""

_MERGE_DEL = """
dm1 AS (SELECT *, CASE WHEN pos - lag(pos + len) OVER w <= 0 THEN 0 ELSE 1 END AS brk FROM delp WHERE pos IS NOT NULL WINDOW w AS (PARTITION BY read_id, chr ORDER BY pos, i)),
dm2 AS (SELECT *, sum(brk) OVER (PARTITION BY read_id, chr ORDER BY pos, i ROWS UNBOUNDED PRECEDING) AS isl FROM dm1),
delm AS (SELECT read_id, chr, CAST(trunc(min(pos)) AS BIGINT) AS pos, CAST(sum(len) AS BIGINT) AS len FROM dm2 GROUP BY read_id, chr, isl)"""

_SIG = """
sig AS (SELECT DISTINCT * FROM (
  SELECT 'DEL' AS sv_type, chr, pos, len, CAST(NULL AS BIGINT) AS q_start, CAST(NULL AS VARCHAR) AS strand, CAST(NULL AS VARCHAR) AS orient, CAST(NULL AS VARCHAR) AS chr2, CAST(NULL AS BIGINT) AS pos2, read_id FROM delm
  UNION ALL SELECT 'INS', chr, pos, len, q_start, strand, NULL, NULL, NULL, read_id FROM insm
  UNION ALL SELECT 'INV', chr, pos, NULL, NULL, NULL, orient, NULL, pos2, read_id FROM (SELECT read_id, chr, orient, pos, pos2 FROM ipair UNION ALL SELECT read_id, chr, orient, pos, pos2 FROM itri)
  UNION ALL SELECT 'TRA', chr, pos, NULL, NULL, NULL, orient, chr2, pos2, read_id FROM tra
  UNION ALL SELECT 'DUP', chr, pos, NULL, NULL, NULL, NULL, NULL, pos2, read_id FROM jump WHERE kind = 'DUP'))"""

SIGNATURES = ",".join([_SEG, _NEAR, _PAIRS, _INSP, _DELP, _INV, _TRA, _JUMP, _MERGE_INS, _MERGE_DEL, _SIG])


def indel(t: str, src: str, bias: int, ratio: float, support: int = 10, p: str = "") -> str:
    """Clusters k{t}, best rows b{t}, alleles a{t} and calls c{t} of signatures src (chr, pos, len, read_id, q_start)."""
    low = min(support, 5)
    sign, search = ("-", "min(pos)") if t == "del" else ("", "trunc(avg(pos))")
    return f"""
k0{t} AS (SELECT chr, pos, len, read_id, q_start, strand, CASE WHEN pos - lag(pos) OVER w <= {bias} THEN 0 ELSE 1 END AS brk FROM {src} WINDOW w AS (PARTITION BY chr ORDER BY pos, len, read_id, q_start)),
k{t} AS (SELECT *, sum(brk) OVER (PARTITION BY chr ORDER BY pos, len, read_id, q_start ROWS UNBOUNDED PRECEDING) AS cluster FROM k0{t}),
b0{t} AS (SELECT *, count(*) OVER (PARTITION BY chr, cluster) AS rows_, row_number() OVER (PARTITION BY chr, cluster, read_id ORDER BY len DESC, pos, q_start) AS rk FROM k{t}),
b{t} AS (SELECT * FROM (SELECT *, count(*) OVER (PARTITION BY chr, cluster) AS reads_ FROM b0{t} WHERE rows_ >= {support} AND rk = 1) WHERE reads_ >= {support}),
a0{t} AS (SELECT *, CASE WHEN len - lag(len) OVER w <= {ratio} * avg(len) OVER (PARTITION BY chr, cluster) THEN 0 ELSE 1 END AS ab FROM b{t} WINDOW w AS (PARTITION BY chr, cluster ORDER BY len, pos, read_id, q_start)),
a{t} AS (SELECT *, sum(ab) OVER (PARTITION BY chr, cluster ORDER BY len, pos, read_id, q_start ROWS UNBOUNDED PRECEDING) AS allele FROM a0{t}),
c{t} AS (SELECT chr, cluster, allele, CAST(trunc(avg(pos)) AS BIGINT) AS pos, {sign}CAST(trunc(avg(len)) AS BIGINT) AS sv_len, count(*) AS support,
  '-' || CAST(floor(1.96 * stddev_pop(pos) / sqrt(count(*))) AS BIGINT) || ',' || CAST(floor(1.96 * stddev_pop(pos) / sqrt(count(*))) AS BIGINT) AS cipos,
  '-' || CAST(floor(1.96 * stddev_pop(len) / sqrt(count(*))) AS BIGINT) || ',' || CAST(floor(1.96 * stddev_pop(len) / sqrt(count(*))) AS BIGINT) AS cilen,
  CAST({search} AS BIGINT) AS search_pos, string_agg(DISTINCT read_id, ',' ORDER BY read_id) AS names FROM a{t} GROUP BY chr, cluster, allele HAVING count(*) >= {low})"""


_DELS = "sdel AS (SELECT * FROM sig WHERE sv_type = 'DEL')," + indel("del", "sdel", 1000, 0.5)
_INSS = "sins AS (SELECT * FROM sig WHERE sv_type = 'INS')," + indel("ins", "sins", 800, 0.9)

_INVS = """
v0 AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 500 AND pos2 - lag(pos2) OVER w <= 500 THEN 0 ELSE 1 END AS brk FROM sig WHERE sv_type = 'INV' WINDOW w AS (PARTITION BY chr, orient ORDER BY pos, pos2, read_id)),
v1 AS (SELECT *, sum(brk) OVER (PARTITION BY chr, orient ORDER BY pos, pos2, read_id ROWS UNBOUNDED PRECEDING) AS cluster FROM v0),
vg AS (SELECT chr, orient, cluster FROM v1 GROUP BY ALL HAVING count(*) >= 10 AND count(DISTINCT read_id) >= 10),
v2 AS (SELECT v1.*, CASE WHEN pos2 - lag(pos2) OVER w <= 500 THEN 0 ELSE 1 END AS ib FROM v1 SEMI JOIN vg USING (chr, orient, cluster) WINDOW w AS (PARTITION BY chr, orient, cluster ORDER BY pos2, pos, read_id)),
v3 AS (SELECT *, sum(ib) OVER (PARTITION BY chr, orient, cluster ORDER BY pos2, pos, read_id ROWS UNBOUNDED PRECEDING) AS inn FROM v2),
v4 AS (SELECT chr, orient, count(*) AS rows_, count(DISTINCT read_id) AS support, CAST(round_even(sum(pos) / count(*), 0) AS BIGINT) AS pos, CAST(round_even(sum(pos2) / count(*), 0) AS BIGINT) AS pos2, string_agg(DISTINCT read_id, ',' ORDER BY read_id) AS names FROM v3 GROUP BY chr, orient, cluster, inn),
cinv AS (SELECT *, pos2 - pos AS sv_len FROM v4 WHERE rows_ >= 10 AND support >= 10 AND pos2 - pos BETWEEN 30 AND 100000)"""

_DUPS = """
u0 AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 500 AND pos2 - lag(pos2) OVER w <= 500 THEN 0 ELSE 1 END AS brk FROM sig WHERE sv_type = 'DUP' WINDOW w AS (PARTITION BY chr ORDER BY pos, pos2, read_id)),
u1 AS (SELECT *, sum(brk) OVER (PARTITION BY chr ORDER BY pos, pos2, read_id ROWS UNBOUNDED PRECEDING) AS cluster FROM u0),
u2 AS (SELECT *, row_number() OVER (PARTITION BY chr, cluster ORDER BY pos, pos2, read_id) - 1 AS k, count(*) OVER (PARTITION BY chr, cluster) AS m FROM u1),
u3 AS (SELECT *, m * 4 // 10 AS lo, m * 6 // 10 AS hi FROM u2),
u4 AS (SELECT chr, count(*) AS rows_, count(DISTINCT read_id) AS support, CAST(trunc(avg(pos) FILTER ((k >= lo AND k < hi) OR (lo = hi AND k = lo))) AS BIGINT) AS pos, CAST(trunc(avg(pos2) FILTER ((k >= lo AND k < hi) OR (lo = hi AND k = lo))) AS BIGINT) AS pos2, string_agg(DISTINCT read_id, ',' ORDER BY read_id) AS names FROM u3 GROUP BY chr, cluster),
cdup AS (SELECT *, pos2 - pos AS sv_len FROM u4 WHERE rows_ >= 10 AND support >= 10 AND pos2 - pos BETWEEN 30 AND 100000)"""

_TRAS = """
x0 AS (SELECT *, CASE WHEN pos - lag(pos) OVER w <= 50 THEN 0 ELSE 1 END AS brk FROM sig WHERE sv_type = 'TRA' WINDOW w AS (PARTITION BY chr, chr2, orient ORDER BY pos, pos2, read_id)),
x1 AS (SELECT *, sum(brk) OVER (PARTITION BY chr, chr2, orient ORDER BY pos, pos2, read_id ROWS UNBOUNDED PRECEDING) AS cluster FROM x0),
x2 AS (SELECT *, CASE WHEN pos2 - lag(pos2) OVER w <= 50 THEN 0 ELSE 1 END AS ib FROM x1 WINDOW w AS (PARTITION BY chr, chr2, orient, cluster ORDER BY pos2, pos, read_id)),
x3 AS (SELECT *, sum(ib) OVER (PARTITION BY chr, chr2, orient, cluster ORDER BY pos2, pos, read_id ROWS UNBOUNDED PRECEDING) AS inn FROM x2),
xr AS (SELECT chr, chr2, orient, cluster, count(*) AS rows_, count(DISTINCT read_id) AS reads_ FROM x3 GROUP BY ALL),
x4 AS (SELECT chr, chr2, orient, cluster, inn, count(DISTINCT read_id) AS support, CAST(trunc(avg(pos)) AS BIGINT) AS pos, CAST(trunc(avg(pos2)) AS BIGINT) AS pos2, string_agg(DISTINCT read_id, ',' ORDER BY read_id) AS names FROM x3 GROUP BY ALL),
x5 AS (SELECT *, row_number() OVER (PARTITION BY chr, chr2, orient, cluster ORDER BY support DESC, inn) AS rk FROM x4),
xd AS (SELECT chr, chr2, orient, cluster, max(support) FILTER (rk = 1) AS d1, coalesce(max(support) FILTER (rk = 2), 0) AS d2 FROM x5 GROUP BY ALL),
ctra AS (SELECT x5.*, CASE orient WHEN 'A' THEN 'N[' || chr2 || ':' || pos2 || '[' WHEN 'B' THEN 'N]' || chr2 || ':' || pos2 || ']' WHEN 'C' THEN '[' || chr2 || ':' || pos2 || '[N' ELSE ']' || chr2 || ':' || pos2 || ']N' END AS alt
  FROM x5 JOIN xd USING (chr, chr2, orient, cluster) JOIN xr USING (chr, chr2, orient, cluster)
  WHERE rows_ >= 10 AND reads_ >= 10 AND CASE WHEN d2 >= 5 THEN rk <= 2 AND d1 + d2 >= rows_ * 0.6 ELSE rk = 1 AND d1 >= rows_ * 0.6 END)"""

_FOLD = """
fs AS (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY chr, rd_l, seg_idx) AS k FROM seg),
fold AS (
  SELECT read_id, CAST(1 AS BIGINT) AS k, chr, rf_l AS a, rf_r AS z, chr AS bc, rf_l AS ba, rf_r AS bz, CAST(0 AS BIGINT) AS bl FROM fs WHERE k = 1
  UNION ALL
  SELECT f.read_id, f.k + 1,
    CASE WHEN s.seg_len < 300 THEN f.chr ELSE s.chr END,
    CASE WHEN s.seg_len < 300 OR (s.chr = f.chr AND s.strand = '+' AND s.rf_l - f.z < 50000) THEN f.a ELSE s.rf_l END,
    CASE WHEN s.seg_len < 300 OR (s.chr = f.chr AND s.strand <> '+' AND f.a - s.rf_r < 50000) THEN f.z ELSE s.rf_r END,
    CASE WHEN c THEN f.chr ELSE f.bc END, CASE WHEN c THEN f.a ELSE f.ba END, CASE WHEN c THEN f.z ELSE f.bz END, CASE WHEN c THEN f.z - f.a ELSE f.bl END
  FROM fold f JOIN fs s ON s.read_id = f.read_id AND s.k = f.k + 1,
  LATERAL (SELECT s.seg_len >= 300 AND NOT (s.chr = f.chr AND CASE WHEN s.strand = '+' THEN s.rf_l - f.z < 50000 ELSE f.a - s.rf_r < 50000 END) AND f.z - f.a > f.bl AS c)),
spans AS (SELECT read_id, CASE WHEN z - a > bl THEN chr ELSE bc END AS chr, CASE WHEN z - a > bl THEN a ELSE ba END AS start, CASE WHEN z - a > bl THEN z ELSE bz END AS "end" FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY k DESC) AS rk FROM fold) WHERE rk = 1)"""


def likelihood(src: str, out: str) -> str:
    """out: src (dr, dv) with gt, pl, gq, qual."""
    return f"""
{out}0 AS (SELECT *, CASE WHEN dr + dv > 100 THEN CAST(floor(100 * (dr / (dr + dv))) AS BIGINT) ELSE dr END AS a FROM {src}),
{out}1 AS (SELECT *, CASE WHEN dr + dv > 100 THEN 100 - a ELSE dv END AS v FROM {out}0),
{out}2 AS (SELECT *, a * log10(0.9::DOUBLE) + v * log10(0.1::DOUBLE) + log10(1.0::DOUBLE / 3) AS l0, (a + v) * log10(0.5::DOUBLE) + log10(1.0::DOUBLE / 3) AS l1, a * log10(0.1::DOUBLE) + v * log10(0.9::DOUBLE) + log10(1.0::DOUBLE / 3) AS l2 FROM {out}1),
{out}3 AS (SELECT *, greatest(l0, l1, l2) AS top FROM {out}2),
{out}4 AS (SELECT *, top + log10(pow(10::DOUBLE, l0 - top) + pow(10::DOUBLE, l1 - top) + pow(10::DOUBLE, l2 - top)) AS lse FROM {out}3),
{out}5 AS (SELECT *, least(l0 - lse, 0) AS n0, least(l1 - lse, 0) AS n1, least(l2 - lse, 0) AS n2 FROM {out}4),
{out} AS (SELECT * EXCLUDE (a, v, l0, l1, l2, top, lse, n0, n1, n2), CASE WHEN n0 >= n1 AND n0 >= n2 THEN '0/0' WHEN n1 >= n2 THEN '0/1' ELSE '1/1' END AS gt,
  CAST(round_even(-10 * n0, 0) AS BIGINT) || ',' || CAST(round_even(-10 * n1, 0) AS BIGINT) || ',' || CAST(round_even(-10 * n2, 0) AS BIGINT) AS pl,
  greatest(CAST(trunc(-10 * log10(pow(10::DOUBLE, n1) + pow(10::DOUBLE, n2))) AS BIGINT), CAST(trunc(-10 * log10(pow(10::DOUBLE, n0) + pow(10::DOUBLE, n2))) AS BIGINT), CAST(trunc(-10 * log10(pow(10::DOUBLE, n0) + pow(10::DOUBLE, n1))) AS BIGINT)) AS gq,
  abs(round_even(-10 * n0, 1)) AS qual FROM {out}5)"""


_CALLS = """
calls0 AS (
  SELECT 'DEL' AS sv_type, chr, pos, sv_len, CAST(NULL AS VARCHAR) AS chr2, CAST(NULL AS BIGINT) AS pos2, CAST(NULL AS VARCHAR) AS orient, CAST(NULL AS VARCHAR) AS alt, support, cipos, cilen, search_pos, names FROM cdel
  UNION ALL SELECT 'INS', chr, pos, sv_len, NULL, NULL, NULL, NULL, support, cipos, cilen, search_pos, names FROM cins
  UNION ALL SELECT 'INV', chr, pos, sv_len, NULL, pos2, orient, NULL, support, NULL, NULL, pos, names FROM cinv
  UNION ALL SELECT 'DUP', chr, pos, sv_len, NULL, pos2, NULL, NULL, support, NULL, NULL, pos, names FROM cdup
  UNION ALL SELECT 'BND', chr, pos, NULL, chr2, pos2, orient, alt, support, NULL, NULL, pos, names FROM ctra),
calls AS (SELECT row_number() OVER () AS call_id, * FROM calls0),
wins AS (SELECT call_id, 1 AS site, chr, CAST(trunc(greatest(search_pos - h, 0)) AS BIGINT) AS ws, CAST(trunc(search_pos + h) AS BIGINT) AS we FROM (SELECT *, CASE sv_type WHEN 'DEL' THEN 1000 WHEN 'INS' THEN 1000 WHEN 'BND' THEN 50 WHEN 'DUP' THEN least(500, sv_len) / 2.0 ELSE 250 END AS h FROM calls)
  UNION ALL SELECT call_id, 2, chr, greatest(pos2 - 250, 0), pos2 + 250 FROM calls WHERE sv_type = 'INV'),
spanning AS (SELECT DISTINCT call_id, site, s.read_id FROM wins w JOIN spans s ON s.chr = w.chr AND s.start < w.ws AND s."end" > w.we),
both_ AS (SELECT call_id, read_id FROM spanning GROUP BY 1, 2 HAVING count(*) = (SELECT count(*) FROM wins WHERE wins.call_id = spanning.call_id)),
sup AS (SELECT call_id, unnest(string_split(names, ',')) AS read_id FROM calls),
drs AS (SELECT call_id, count(*) AS dr FROM (SELECT call_id, read_id FROM both_ EXCEPT SELECT call_id, read_id FROM sup) GROUP BY 1),
gin AS (SELECT calls.*, coalesce(dr, 0) AS dr, len(string_split(names, ',')) AS dv FROM calls LEFT JOIN drs USING (call_id))"""

ALL_CALLS = ",".join([SIGNATURES, _DELS, _INSS, _INVS, _DUPS, _TRAS, _FOLD, _CALLS, likelihood("gin", "geno")])
_VCF = """
num AS (SELECT *, row_number() OVER (PARTITION BY sv_type ORDER BY chr, pos, pos2 NULLS FIRST, chr2 NULLS FIRST, sv_len NULLS FIRST, orient NULLS FIRST, alt NULLS FIRST, support) - 1 AS k FROM geno),
vcf AS (SELECT chr AS CHROM, pos + 1 AS POS, 'ravel.' || sv_type || '.' || k AS ID, 'N' AS REF, CASE WHEN sv_type = 'BND' THEN alt ELSE '<' || sv_type || '>' END AS ALT, CAST(qual AS VARCHAR) AS QUAL, CASE WHEN qual >= 5 THEN 'PASS' ELSE 'q5' END AS FILTER,
  CASE WHEN gt = '0/0' THEN 'IMPRECISE' ELSE 'PRECISE' END || ';SVTYPE=' || sv_type || CASE WHEN sv_type <> 'BND' THEN ';SVLEN=' || sv_len || ';END=' || (CASE WHEN sv_type = 'INS' THEN pos + 1 ELSE pos + 1 + abs(sv_len) END) ELSE '' END
  || CASE WHEN sv_type IN ('DEL', 'INS') THEN ';CIPOS=' || cipos || ';CILEN=' || cilen ELSE '' END || ';RE=' || support || CASE WHEN sv_type = 'DUP' THEN ';STRAND=-+' WHEN sv_type = 'INV' THEN ';STRAND=' || orient ELSE '' END || ';RNAMES=NULL' || CASE WHEN sv_type = 'DEL' THEN ';STRAND=+-' ELSE '' END AS INFO,
  'GT:DR:DV:PL:GQ' AS FORMAT, gt || ':' || dr || ':' || support || ':' || pl || ':' || gq AS SAMPLE FROM num)"""

_LET = "substr('ACGT', CAST((((%s) * 1103515245 + 12345) >> 12) % 4 + 1 AS BIGINT), 1)"


def _letters(number: str) -> str:
    return _LET.replace("%s", number)


#: The letters of planted contigs and reads, by the rule of the adapters; the read that an insertion's sequence is taken from.
_SEQ = f"""
rep AS (SELECT * FROM (SELECT chr, cluster, allele, q_start, len AS q_len, read_id AS q_read, strand AS q_strand, row_number() OVER (PARTITION BY chr, cluster, allele ORDER BY CASE WHEN nr THEN 0 ELSE 1 END, CASE WHEN nr THEN far END NULLS FIRST, len, pos, read_id, q_start) AS rk
  FROM (SELECT *, abs(len - avg(len) OVER g) < 5 AND abs(pos - avg(pos) OVER g) < 2000 AS nr, abs(pos - avg(pos) OVER g) AS far FROM ains WINDOW g AS (PARTITION BY chr, cluster, allele))) WHERE rk = 1),
iq AS (SELECT c.chr, c.pos, c.sv_len, c.names, q_start, q_len, q_strand, CAST(substr(q_read, 2) AS BIGINT) AS o FROM cins c JOIN rep USING (chr, cluster, allele)),
ii AS (SELECT chr, pos, sv_len, names, CASE WHEN q_strand = '-' THEN array_to_string(list_transform(range(0, q_len), lambda i: translate({_letters("(6400 + ((o % 40) * 37) % 900 - q_start - 1 - i) * 7 + o")}, 'ACGT', 'TGCA')), '')
  ELSE array_to_string(list_transform(range(q_start, q_start + q_len), lambda i: {_letters("i * 7 + o")}), '') END AS ins FROM iq),
rs AS (SELECT *, CASE WHEN sv_type IN ('DEL', 'INS') THEN greatest(pos - 1, 0) ELSE pos END AS at_, CASE WHEN sv_type = 'DEL' THEN pos - sv_len - greatest(pos - 1, 0) ELSE 1 END AS len_, CAST(substr(chr, 4) AS BIGINT) AS cn FROM num),
rt AS (SELECT *, array_to_string(list_transform(range(at_, at_ + len_), lambda i: {_letters("i * 3 + cn")}), '') AS ref FROM rs)"""
_TRUTH = """
tl AS (SELECT DISTINCT o_orderkey % 40 AS l FROM orders),
tv0 AS (SELECT l, ['DEL', 'INS', 'INV', 'DUP', 'BND'][CAST(l % 5 + 1 AS INTEGER)] AS t, 400 + (l * 37) % 900 AS n, 100000 + 50000 * l AS p, 'chr' || (l % 3 + 1) AS a, 'chr' || ((l + 1) % 3 + 1) AS b FROM tl),
truth AS (SELECT l AS truth_no, t AS sv_type, CASE WHEN t = 'BND' THEN least(a, b) ELSE a END AS chr, CASE WHEN t = 'BND' AND b < a THEN p + 7000 ELSE p END AS start, CASE WHEN t IN ('DEL', 'INV', 'DUP') THEN p + n END AS "end", CASE WHEN t <> 'BND' THEN n END AS sv_len, CASE WHEN t = 'BND' THEN greatest(a, b) END AS chr2, CASE WHEN t = 'BND' THEN CASE WHEN b < a THEN p ELSE p + 7000 END END AS pos2 FROM tv0),
gts AS (SELECT * FROM (VALUES ('chr1', 'hom'), ('chr2', 'het'), ('chr3', 'hom')) g(chr, genotype)),
ev AS (SELECT *, CASE WHEN gt = '0/1' THEN 'het' WHEN gt = '1/1' THEN 'hom' ELSE 'unknown' END AS g FROM geno)"""
_MATCH = """
mi AS (SELECT c.call_id, t.truth_no, c.sv_type, c.chr, CAST(NULL AS VARCHAR) AS chr2, c.g FROM ev c JOIN truth t ON t.sv_type = 'INS' AND c.sv_type = 'INS' AND t.chr = c.chr AND abs(c.pos + 1 - t.start) <= 1000 AND least(c.sv_len, t.sv_len) / greatest(c.sv_len, t.sv_len) >= 0.7),
mb AS (SELECT c.call_id, t.truth_no, c.sv_type, c.chr, c.chr2, c.g FROM ev c JOIN truth t ON t.sv_type = 'BND' AND c.sv_type = 'BND' AND t.chr = c.chr AND t.chr2 = c.chr2 AND abs(c.pos + 1 - t.start) <= 1000 AND abs(c.pos2 - t.pos2) <= 1000),
mo AS (SELECT c.call_id, t.truth_no, c.sv_type, c.chr, CAST(NULL AS VARCHAR) AS chr2, c.g FROM ev c JOIN truth t ON t.sv_type = c.sv_type AND c.sv_type IN ('DEL', 'INV', 'DUP') AND t.chr = c.chr AND greatest(c.pos + 1 - 1000, t.start) <= least(c.pos + 1 + abs(c.sv_len) + 1000, t."end") AND least(abs(c.sv_len), t.sv_len) / greatest(abs(c.sv_len), t.sv_len) >= 0.7),
ml AS (SELECT m.*, CASE WHEN coalesce(m.g = x.genotype, false) OR coalesce(m.g = y.genotype, false) THEN 2 ELSE 1 END AS level FROM (SELECT * FROM mi UNION ALL SELECT * FROM mb UNION ALL SELECT * FROM mo) m LEFT JOIN gts x ON x.chr = m.chr LEFT JOIN gts y ON y.chr = m.chr2)"""

#: Call sets and modes side by side.
_SETS = """
md AS (SELECT * FROM (VALUES ('IID', ['INS', 'INV', 'DEL']), ('DUP', ['INS', 'DUP']), ('BND', ['BND'])) m(mode, types)),
st AS (SELECT 'all' AS caller, * FROM ev UNION ALL SELECT 'pass', * FROM ev WHERE qual >= 5 UNION ALL SELECT 'hom', * FROM ev WHERE gt = '1/1' UNION ALL SELECT 'het', * FROM ev WHERE gt = '0/1' UNION ALL SELECT 'even', * FROM ev WHERE (pos + 1) % 2 = 0),
sc AS (SELECT * FROM (SELECT mode, types, caller, call_id, CASE WHEN mode = 'IID' AND sv_type = 'DUP' THEN 'INS' ELSE sv_type END AS t, chr, pos + 1 AS pos, abs(sv_len) AS n, chr2, pos2, g FROM st, md) WHERE list_contains(types, t)),
tm AS (SELECT mode, truth.* FROM truth, md WHERE list_contains(types, sv_type)),
pm AS (SELECT c.mode, caller, call_id, truth_no, c.chr, CASE WHEN c.t = 'BND' THEN c.chr2 END AS chr2, c.g FROM sc c JOIN tm t ON t.mode = c.mode AND t.chr = c.chr AND CASE
  WHEN c.t = 'INS' THEN (t.sv_type = 'INS' OR (c.mode = 'DUP' AND t.sv_type IN ('DEL', 'INV', 'DUP'))) AND abs(c.pos - t.start) <= 1000 AND least(c.n, t.sv_len) / greatest(c.n, t.sv_len) >= 0.7
  WHEN c.t = 'BND' THEN t.sv_type = 'BND' AND t.chr2 = c.chr2 AND abs(c.pos - t.start) <= 1000 AND abs(c.pos2 - t.pos2) <= 1000
  ELSE t.sv_type = c.t AND greatest(c.pos - 1000, t.start) <= least(c.pos + c.n + 1000, t."end") AND least(c.n, t.sv_len) / greatest(c.n, t.sv_len) >= 0.7 END),
pl AS (SELECT pm.*, CASE WHEN coalesce(pm.g = x.genotype, false) OR coalesce(pm.g = y.genotype, false) THEN 2 ELSE 1 END AS level FROM pm LEFT JOIN gts x ON x.chr = pm.chr LEFT JOIN gts y ON y.chr = pm.chr2),
sd AS (SELECT c.mode, c.caller, c.t AS sv_type, 'precision' AS side, coalesce(max(level), 0) AS level FROM sc c LEFT JOIN pl ON pl.mode = c.mode AND pl.caller = c.caller AND pl.call_id = c.call_id GROUP BY c.mode, c.caller, c.t, c.call_id
  UNION ALL SELECT t.mode, k.caller, t.sv_type, 'recall', coalesce(max(level), 0) FROM tm t CROSS JOIN (SELECT DISTINCT caller FROM (VALUES ('all'), ('pass'), ('hom'), ('het'), ('even')) v(caller)) k LEFT JOIN pl ON pl.mode = t.mode AND pl.caller = k.caller AND pl.truth_no = t.truth_no GROUP BY t.mode, k.caller, t.sv_type, t.truth_no)"""

_POINTS = """
pts AS (SELECT event_type AS chr, date_diff('second', TIMESTAMP '1970-01-01', ts) - 1704067200 AS pos, CAST(floor(value) AS BIGINT) AS len, CAST(user_id AS VARCHAR) AS read_id, event_id AS q_start, CAST(NULL AS VARCHAR) AS strand FROM events)"""
_SPANS = """
spans AS (SELECT event_type AS chr, date_diff('second', TIMESTAMP '1970-01-01', ts) - 1704067200 AS start, date_diff('second', TIMESTAMP '1970-01-01', ts) - 1704067200 + CAST(floor(value * 20) AS BIGINT) AS "end", CAST(event_id AS VARCHAR) AS read_id FROM events),
wins AS (SELECT CAST(event_id AS VARCHAR) AS call_id, 1 AS site, event_type AS chr, greatest(date_diff('second', TIMESTAMP '1970-01-01', ts) - 1704067200 - 500, 0) AS ws, date_diff('second', TIMESTAMP '1970-01-01', ts) - 1704067200 + 500 AS we FROM events WHERE event_id % 50 = 0)"""

_KMERS = """
ix AS (SELECT 'b' || item_id AS chr, i AS pos, substring(text, CAST(i AS BIGINT), 22) AS kmer FROM (SELECT item_id, text, unnest(range(1, length(text) - 22 + 2)) AS i FROM benchmark WHERE length(text) >= 22)),
rare AS (SELECT kmer, count(*) AS copies FROM ix GROUP BY 1 HAVING count(*) <= 5)"""
_SEEDS = """
z0 AS (SELECT 'd' || doc_id AS read_id, text AS run, length(text) AS n, length(text) >= 300 AS long FROM documents),
z1 AS (SELECT *, CASE WHEN long THEN 6 ELSE 0 END AS hn, CASE WHEN long THEN 80 ELSE 20 END AS mf, CASE WHEN long THEN n - 200 ELSE n END AS ml, CASE WHEN long THEN n - 100 ELSE n END AS me FROM z0),
z2 AS (SELECT *, greatest(0, CAST(ceil((me - 22 - mf) / 20.0) AS BIGINT)) AS mn FROM z1),
z3 AS (SELECT *, mf + mn * 20 AS tf FROM z2),
z4 AS (SELECT *, CASE WHEN long THEN greatest(0, CAST(ceil((n - 22 - tf) / 10.0) AS BIGINT)) ELSE 0 END AS tn FROM z3),
seeds AS (SELECT read_id, 'head' AS zone, 20 + 10 * i + 1 AS pos, 3 AS cap, run FROM (SELECT *, unnest(range(0, hn)) AS i FROM z4)
  UNION ALL SELECT read_id, 'middle', mf + 20 * i + 1, ml // 20, run FROM (SELECT *, unnest(range(0, mn)) AS i FROM z4)
  UNION ALL SELECT read_id, 'tail', tf + 10 * i + 1, 3, run FROM (SELECT *, unnest(range(0, tn)) AS i FROM z4)),
sk AS (SELECT read_id, zone, CAST(pos AS BIGINT) AS pos, CAST(cap AS BIGINT) AS cap, substring(run, CAST(pos AS BIGINT), 22) AS kmer FROM seeds)"""
_HITS = """
h0 AS (SELECT sk.read_id, ix.chr, sk.zone, sk.cap, sk.pos AS rd, ix.pos AS rf FROM sk JOIN ix USING (kmer) JOIN rare USING (kmer)),
hits AS (SELECT read_id, chr, rd, rf FROM (SELECT *, dense_rank() OVER (PARTITION BY read_id, zone ORDER BY rd) AS k FROM h0) WHERE k <= cap)"""
_MEM = """
m0 AS (SELECT *, CASE WHEN rd - lag(rd) OVER (PARTITION BY read_id, chr, rf - rd ORDER BY rd) <= 22 THEN 0 ELSE 1 END AS brk FROM hits),
m1 AS (SELECT *, sum(brk) OVER (PARTITION BY read_id, chr, rf - rd ORDER BY rd ROWS UNBOUNDED PRECEDING) AS isl FROM m0),
mem AS (SELECT read_id, chr, min(rd) AS rd_l, max(rd) + 21 AS rd_r, min(rf) AS rf_l, max(rf) + 21 AS rf_r, max(rd) + 22 - min(rd) AS len FROM m1 GROUP BY read_id, chr, rf - rd, isl)"""

#: Links between k-mers, followed one after another from each head.
_UNI = """
nx AS (SELECT *, coalesce(lag(kmer) OVER w, '') AS p, coalesce(lead(kmer) OVER w, '') AS n FROM ix WINDOW w AS (PARTITION BY chr ORDER BY pos)),
nb AS (SELECT kmer, count(*) AS copies, min(p) AS pa, max(p) AS pb, min(n) AS na, max(n) AS nb FROM nx GROUP BY kmer),
lk AS (SELECT a.kmer AS u, b.kmer AS v FROM nb a JOIN nb b ON b.kmer = a.na WHERE a.na = a.nb AND b.pa = b.pb AND b.pa = a.kmer),
up AS (SELECT kmer AS head, kmer AS last, 1 AS n FROM nb WHERE kmer NOT IN (SELECT v FROM lk) UNION ALL SELECT head, v, n + 1 FROM up JOIN lk ON u = last)"""
#: The search by halves step by step, then the ranks around what it finds.
_SAMPLE = """
rk AS (SELECT *, row_number() OVER (PARTITION BY chr ORDER BY start, "end", read_id) - 1 AS rank, count(*) OVER (PARTITION BY chr) AS of FROM spans),
wa AS (SELECT call_id, chr, ws, we, %s AS cap FROM (SELECT CAST(event_id AS VARCHAR) AS call_id, event_type AS chr, greatest(date_diff('second', TIMESTAMP '1970-01-01', ts) - 1704067200 - 500, 0) AS ws, date_diff('second', TIMESTAMP '1970-01-01', ts) - 1704067200 + 500 AS we, event_id %% 20 + 1 AS n FROM events)),
bs AS (SELECT call_id, wa.chr, ws, we, cap, of, CAST(0 AS BIGINT) AS low, of - 1 AS high, CAST(-1 AS BIGINT) AS hit FROM wa JOIN (SELECT DISTINCT chr, of FROM rk) USING (chr)
  UNION ALL SELECT call_id, b.chr, ws, we, cap, b.of, CASE WHEN we >= start AND ws > "end" THEN rank + 1 ELSE low END, CASE WHEN we < start THEN rank - 1 ELSE high END, CASE WHEN we >= start AND ws <= "end" THEN rank ELSE -1 END
  FROM bs b JOIN rk ON rk.chr = b.chr AND rk.rank = (low + high) >> 1 WHERE hit < 0 AND low <= high),
sp AS (SELECT DISTINCT call_id, read_id FROM bs b JOIN rk ON rk.chr = b.chr AND rank >= greatest(hit - cap // 2, 0) AND rank < CASE WHEN hit + cap // 2 >= b.of THEN b.of - 1 ELSE hit + cap // 2 END
  WHERE hit >= 0 AND start <= we AND start < ws AND "end" > we)""" % "CASE WHEN n <= 2 THEN 10 * n WHEN n <= 5 THEN 5 * n WHEN n <= 15 THEN 4 * n ELSE 3 * n END"
_LINEAR = """
ln AS (SELECT w.call_id, cap, read_id, row_number() OVER (PARTITION BY w.call_id ORDER BY start, "end", read_id) AS k FROM (SELECT *, %s AS cap FROM (SELECT *, CAST(call_id AS BIGINT) %% 20 + 1 AS n FROM wins)) w JOIN spans s ON s.chr = w.chr AND start < ws AND "end" > we)""" % "CASE WHEN n <= 2 THEN 10 * n WHEN n <= 5 THEN 5 * n WHEN n <= 15 THEN 4 * n ELSE 3 * n END"
_PM = "(-10 * log10(0.25 / (1 - 0.01727)))"
#: Maximal exact matches from the hits of all positions, the seeds of the grid with their match, and the walk, a place a step.
_WALK = f"""
size AS (SELECT sum(length(text)) AS g FROM benchmark),
dk AS (SELECT 'd' || doc_id AS read_id, length(text) AS n, i AS rd, substring(text, CAST(i AS BIGINT), 22) AS kmer FROM (SELECT doc_id, text, unnest(range(1, length(text) - 22 + 2)) AS i FROM documents WHERE length(text) >= 22)),
ah AS (SELECT read_id, n, chr, rd, ix.pos AS rf, kmer FROM dk JOIN ix USING (kmer)),
a1 AS (SELECT *, rd - row_number() OVER (PARTITION BY read_id, chr, rf - rd ORDER BY rd) AS isl FROM ah),
a2 AS (SELECT *, min(rd) OVER w - 1 AS a, max(rd) OVER w + 20 AS z FROM a1 WINDOW w AS (PARTITION BY read_id, chr, rf - rd, isl)),
hl AS (SELECT read_id, n, rd - 1 AS j, list({{'chr': chr, 'd': rf - rd, 'a': a, 'z': z}}) AS hs FROM a2 JOIN rare USING (kmer) WHERE rd > 20 AND (rd - 21) % 10 = 0 GROUP BY read_id, n, rd),
wk AS (SELECT DISTINCT read_id, n, CASE WHEN n >= 300 THEN 0 ELSE 1 END AS zone, CAST(20 AS BIGINT) AS place, CAST(0 AS BIGINT) AS cnt, CAST(0 AS BIGINT) AS covered, CAST(NULL AS BIGINT) AS seed, CAST([] AS STRUCT(chr VARCHAR, d BIGINT, l BIGINT, r BIGINT)[]) AS kept FROM hl
  UNION ALL SELECT read_id, n, CASE WHEN done THEN zone + 1 ELSE zone END, CASE WHEN done THEN place ELSE place + stride END, CASE WHEN done THEN 0 ELSE cnt + CASE WHEN len(k) > 0 THEN 1 ELSE 0 END END,
    greatest(covered, coalesce(list_max(list_transform(k, lambda x: x.r)), 0)), place, k
  FROM (SELECT *, list_filter(list_transform(CASE WHEN done OR place + 22 < covered THEN [] ELSE coalesce(hs, []) END,
      lambda h: {{'chr': h.chr, 'd': h.d, 'l': least(place, greatest(h.a, CASE WHEN covered > 0 THEN covered + 1 ELSE 0 END, place - 5000)), 'r': least(h.z, place + 21 + 5000)}}),
      lambda x: x.r - x.l + 1 >= 29 AND (x.r - x.l + 1) * {_PM} - 10 * log10(g) >= 29) AS k
    FROM (SELECT w.*, hl.hs, g, cnt >= CASE WHEN zone <> 1 THEN 3 WHEN w.n >= 300 THEN (w.n - 200) // 20 ELSE w.n // 20 END OR place + 22 >= CASE zone WHEN 0 THEN 100 WHEN 1 THEN CASE WHEN w.n >= 300 THEN w.n - 100 ELSE w.n END ELSE w.n END AS done,
        CASE zone WHEN 1 THEN 20 ELSE 10 END AS stride
      FROM (SELECT read_id, n, zone, place, cnt, covered FROM wk WHERE zone < CASE WHEN n >= 300 THEN 3 ELSE 2 END) w CROSS JOIN size LEFT JOIN hl ON hl.read_id = w.read_id AND hl.j = w.place)))"""
#: Each side's reach as the best of all pairs of beginnings that differ by two edits at most.
_REACH = """
docs_a AS (SELECT doc_id, regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g') AS text FROM documents),
bench_a AS (SELECT item_id, regexp_replace(text, '[^\\x00-\\x7F]', '~', 'g') AS text FROM benchmark)"""
_SIDES = """
an AS (SELECT mem.*, row_number() OVER () AS no, d.text AS p, b.text AS q FROM mem JOIN docs_a d ON mem.read_id = 'd' || d.doc_id JOIN bench_a b ON mem.chr = 'b' || b.item_id),
sd AS (SELECT no, 'l' AS side, reverse(substring(p, greatest(1, rd_l - 40), rd_l - greatest(1, rd_l - 40))) AS p, reverse(substring(q, greatest(1, rf_l - 40), rf_l - greatest(1, rf_l - 40))) AS q FROM an
  UNION ALL SELECT no, 'r', substring(p, rd_r + 1, 40), substring(q, rf_r + 1, 40) FROM an),
ab AS (SELECT no, side, a, b, levenshtein(substring(p, 1, a), substring(q, 1, b)) AS e FROM (SELECT *, unnest(range(greatest(0, a - 2), least(length(q), a + 2) + 1)) AS b FROM (SELECT *, unnest(range(0, length(p) + 1)) AS a FROM sd))),
re AS (SELECT * FROM ab WHERE e <= 2 QUALIFY row_number() OVER (PARTITION BY no, side ORDER BY a DESC, e, b DESC) = 1)"""


def _plain(*parts: str) -> tuple[str, ...]:
    return tuple(p.replace("FROM documents", "FROM docs_a").replace("FROM benchmark", "FROM bench_a") for p in parts)


def q(select: str, *parts: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}{','.join(parts)}\n{select}" if parts else select


_N = ",".join([_SEG, _NEAR])
_NP = ",".join([_N, _PAIRS])
_LN = ",".join([_LINES, _NEAR, _PAIRS])
_A = ALL_CALLS
_E = ",".join([ALL_CALLS, _TRUTH])
_FMT = "chr || ',' || strand || ',' || rd_l || ',' || rd_r || ',' || rf_l || ',' || rf_r || ',' || seg_len"

ORACLES = {
    "scan_svseg_roundtrip": q("SELECT read_id, read_len, seg_idx, chr, strand, rd_l, rd_r, rf_l, rf_r, seg_len FROM seg", _SEG),
    "write_svseg": q(f"SELECT read_id, '>' || read_id || ' ' || read_len || chr(10) || string_agg({_FMT}, '|' ORDER BY seg_idx) AS value FROM seg GROUP BY read_id, read_len", _SEG),
    "usable_segments": q("SELECT read_id, seg_idx, chr, strand, rd_l, rd_r, rf_l, rf_r, seg_len FROM us", _LINES, _NEAR),
    "signature_partitions": q("SELECT DISTINCT sv_type, chr, coalesce(chr2, '') AS chr2 FROM sig", SIGNATURES),
    "read_eligibility": "SELECT 'd' || doc_id AS read_id, CAST(list_sum(list_transform(regexp_extract_all(text, '[^Nn]{22,}'), lambda x: length(x))) AS BIGINT) AS usable FROM documents WHERE length(text) >= 100 AND list_sum(list_transform(regexp_extract_all(text, '[^Nn]{22,}'), lambda x: length(x))) > 22",
    "kmer_index": q("SELECT chr, CAST(pos AS BIGINT) AS pos, kmer FROM ix", _KMERS),
    "kmer_frequency_prune": q("SELECT chr, CAST(pos AS BIGINT) AS pos, kmer, copies FROM ix JOIN rare USING (kmer)", _KMERS),
    "seed_sampling": q("SELECT read_id, zone, pos, cap, kmer FROM sk", _SEEDS),
    "seed_join": q("SELECT * FROM hits", _KMERS, _SEEDS, _HITS),
    "unipath_index": q("SELECT chr, pos, kmers, copies FROM (SELECT head, max(n) AS kmers FROM up GROUP BY head) JOIN nb ON nb.kmer = head JOIN (SELECT * FROM ix QUALIFY row_number() OVER (PARTITION BY kmer ORDER BY chr, pos) = 1) f ON f.kmer = head", _KMERS, _UNI, recursive=True),
    "kmer_limits": "WITH ix AS (SELECT 'b' || item_id AS chr, i AS pos, substring(text, CAST(i AS BIGINT), 22) AS kmer FROM (SELECT item_id, text, unnest(range(1, length(text) - 22 + 2)) AS i FROM benchmark WHERE length(text) >= 22)), c AS (SELECT kmer, substring(kmer, 1, 8) AS s, count(*) AS n FROM ix GROUP BY 1), f AS (SELECT s FROM c GROUP BY s HAVING count(*) <= 30) SELECT c.s AS kmer, chr, pos FROM ix JOIN c USING (kmer) JOIN f ON f.s = c.s WHERE n <= 5",
    "seed_walk": q("SELECT read_id, x.chr AS chr, seed + 1 AS seed, x.l + 1 AS rd_l, x.r + 1 AS rd_r, x.l + x.d + 1 AS rf_l, x.r + x.d + 1 AS rf_r FROM (SELECT read_id, seed, unnest(kept) AS x FROM wk)", _KMERS, _WALK, recursive=True),
    "bounded_extension": q("SELECT an.read_id, an.chr, rd_l - l.a AS rd_l, rd_r + r.a AS rd_r, rf_l - l.b AS rf_l, rf_r + r.b AS rf_r, l.e + r.e AS edits FROM an JOIN re l ON l.no = an.no AND l.side = 'l' JOIN re r ON r.no = an.no AND r.side = 'r'", _REACH, *_plain(_KMERS, _SEEDS), _HITS, _MEM, _SIDES),
    "mem_diagonal_merge": q("SELECT * FROM mem", _KMERS, _SEEDS, _HITS, _MEM),
    "anchor_score": q("SELECT *, round(len * (-10 * log10(0.25 / (1 - 0.01727))) - 10 * log10(1000000.0), 6) AS score FROM mem WHERE len >= 29 AND len * (-10 * log10(0.25 / (1 - 0.01727))) - 10 * log10(1000000.0) >= 29", _KMERS, _SEEDS, _HITS, _MEM),
    "strand_select": "WITH s AS (SELECT 'c' || o_custkey AS read_id, CASE WHEN o_orderkey % 2 = 0 THEN '-' ELSE '+' END AS strand, max(o_orderkey % 400) AS score FROM orders GROUP BY 1, 2), t AS (SELECT *, max(score) OVER (PARTITION BY read_id) AS top, row_number() OVER (PARTITION BY read_id ORDER BY score DESC, strand = '-' DESC) AS k FROM s) SELECT read_id, strand, score, k = 1 AS \"primary\" FROM t WHERE top >= 100",
    "revcomp": "SELECT item_id, md5(reverse(translate(text, 'ACGTacgt', 'TGCAtgca'))) AS revcomp_md5, length(text) AS n FROM benchmark",
    "orient_pairs": q("SELECT read_id, i, chr, strand, r1e, r2s, g1e, g2s, gr, gg, d FROM cp", _LN),
    "inv_pair": q("SELECT read_id, chr, orient, pos, pos2 FROM ipair WHERE n = 2", _LINES, _NEAR, _INV),
    "inv_triple": q("SELECT read_id, chr, orient, pos, pos2 FROM itri UNION ALL SELECT read_id, chr, orient, pos, pos2 FROM ipair WHERE n >= 3", _LINES, _NEAR, _INV),
    "ins_pair": q("SELECT read_id, chr, strand, i, pos, len, q_start FROM insp WHERE pos IS NOT NULL", _LN, _INSP),
    "del_pair": q("SELECT read_id, chr, i, pos, len FROM delp WHERE pos IS NOT NULL", _LN, _DELP),
    "tra_pair": q("SELECT read_id, chr, orient, pos, chr2, pos2 FROM tra", _LINES, _NEAR, _TRA),
    "tra_ins_dup": q("SELECT read_id, chr, strand, i, kind, pos, len, q_start, CAST(pos2 AS BIGINT) AS pos2 FROM jump", _LINES, _NEAR, _JUMP),
    "merge_ins_in_read": q("SELECT read_id, chr, strand, pos, len, q_start FROM insm", _LN, _INSP, _JUMP, _MERGE_INS),
    "merge_del_in_read": q("SELECT read_id, chr, pos, len FROM delm", _LN, _DELP, _MERGE_DEL),
    "signature_dedup": q("SELECT sv_type, chr, pos, len, q_start, strand, orient, chr2, pos2, read_id FROM sig", SIGNATURES),
    "cluster_del_position": q("SELECT chr, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM kdel GROUP BY chr, cluster", _POINTS, indel("del", "pts", 1000, 0.5)),
    "cluster_ins_position": q("SELECT chr, min(pos) AS first_pos, max(pos) AS last_pos, count(*) AS n FROM kins GROUP BY chr, cluster", _POINTS, indel("ins", "pts", 800, 0.9)),
    "best_per_read": q("SELECT chr, pos, len, read_id, q_start FROM bdel", _POINTS, indel("del", "pts", 1000, 0.5)),
    "length_alleles": q("SELECT chr, min(pos) AS first_pos, min(len) AS min_len, max(len) AS max_len, count(*) AS n FROM adel GROUP BY chr, cluster, allele", _POINTS, indel("del", "pts", 1000, 0.1)),
    "allele_summary": q("SELECT chr, pos, sv_len, support, cipos, cilen, search_pos, names FROM cdel", _POINTS, indel("del", "pts", 1000, 0.1)),
    "ins_representative": q("SELECT chr, q_start, q_len, q_read FROM (SELECT chr, q_start, len AS q_len, read_id AS q_read, row_number() OVER (PARTITION BY chr, cluster, allele ORDER BY CASE WHEN nr THEN 0 ELSE 1 END, CASE WHEN nr THEN far END NULLS FIRST, len, pos, read_id, q_start) AS rk FROM (SELECT *, abs(len - avg(len) OVER g) < 5 AND abs(pos - avg(pos) OVER g) < 2000 AS nr, abs(pos - avg(pos) OVER g) AS far FROM ains WINDOW g AS (PARTITION BY chr, cluster, allele))) WHERE rk = 1", _POINTS, indel("ins", "pts", 800, 0.1)),
    "cluster_inv": q("SELECT chr, orient, pos, pos2, sv_len, support, names FROM cinv", SIGNATURES, _INVS),
    "cluster_dup_trimmed": q("SELECT chr, pos, pos2, sv_len, support, names FROM cdup", SIGNATURES, _DUPS),
    "cluster_tra_top2": q("SELECT chr, chr2, orient, pos, pos2, support, names FROM ctra", SIGNATURES, _TRAS),
    "bnd_alt": q("SELECT chr, pos, alt FROM ctra", SIGNATURES, _TRAS),
    "spanning_reads": q('SELECT w.call_id, s.read_id FROM wins w JOIN spans s ON s.chr = w.chr AND s.start < w.ws AND s."end" > w.we', _SPANS),
    "reference_reads": q("SELECT sv_type, chr, pos, sv_len, support, dr FROM gin", _A, recursive=True),
    "both_ends_spanning": q("SELECT c.chr, c.pos, c.pos2, c.orient, count(*) AS n FROM calls c JOIN both_ USING (call_id) WHERE c.sv_type = 'INV' GROUP BY ALL", _A, recursive=True),
    "read_span_fold": q("SELECT chr, start, \"end\", read_id FROM spans", _LINES, _FOLD, recursive=True),
    "read_span_unstranded": q("""SELECT chr, a AS start, z AS "end", read_id FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY z - a DESC, isl) AS rk FROM (SELECT read_id, isl, min(chr) AS chr, arg_min(rf_l, k) AS a, arg_max(rf_r, k) AS z FROM (SELECT *, sum(brk) OVER (PARTITION BY read_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS isl FROM (SELECT *, CASE WHEN chr = lag(chr) OVER w AND rf_l - lag(rf_r) OVER w < 50000 THEN 0 ELSE 1 END AS brk FROM (SELECT *, row_number() OVER (PARTITION BY read_id ORDER BY chr, rf_l, rf_r, seg_idx) AS k FROM seg) WHERE k = 1 OR seg_len >= 300 WINDOW w AS (PARTITION BY read_id ORDER BY k))) GROUP BY read_id, isl)) WHERE rk = 1""", _LINES),
    "ref_cap": "SELECT DISTINCT n, CASE WHEN n <= 2 THEN 10 * n WHEN n <= 5 THEN 5 * n WHEN n <= 15 THEN 4 * n ELSE 3 * n END AS cap FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey)",
    "sampled_coverage": q("SELECT call_id, count(*) AS n, min(read_id) AS first_read FROM sp GROUP BY 1", _SPANS, _SAMPLE, recursive=True),
    "linear_coverage": q("SELECT call_id, count(*) AS reads, count(*) >= first(cap) AS \"full\" FROM ln WHERE k <= cap GROUP BY 1", _SPANS, _LINEAR),
    "capped_reference_reads": q("SELECT w.call_id, count(*) AS n FROM (SELECT w.call_id, s.read_id, row_number() OVER (PARTITION BY w.call_id ORDER BY s.read_id) AS k FROM wins w JOIN spans s ON s.chr = w.chr AND s.start < w.ws AND s.\"end\" > w.we) w WHERE k <= 10 GROUP BY 1", _SPANS),
    "rescale_counts": "SELECT DISTINCT c0, c1, CASE WHEN c0 + c1 > 100 THEN CAST(floor(100 * (c0 / (c0 + c1))) AS BIGINT) ELSE c0 END AS a, CASE WHEN c0 + c1 > 100 THEN 100 - CAST(floor(100 * (c0 / (c0 + c1))) AS BIGINT) ELSE c1 END AS b FROM (SELECT o_orderkey % 121 AS c0, 1 + o_custkey % 120 AS c1 FROM orders)",
    "genotype_likelihood": q("SELECT dr, dv, gt, pl, gq, qual FROM lk", "cc AS (SELECT DISTINCT o_orderkey % 121 AS dr, 1 + o_custkey % 120 AS dv FROM orders)", likelihood("cc", "lk")),
    "missing_genotype": q("SELECT sv_type, chr, pos, sv_len, support, './.' AS gt, '.,.,.' AS pl, '.' AS dr, '.' AS gq, '.' AS qual, 'PASS' AS filter FROM calls", _A, recursive=True),
    "filter_label": q("SELECT dr, dv, qual, CASE WHEN qual >= 5 THEN 'PASS' ELSE 'q5' END AS filter FROM lk", "cc AS (SELECT DISTINCT o_orderkey % 121 AS dr, 1 + o_custkey % 120 AS dv FROM orders)", likelihood("cc", "lk")),
    "vcf_records": q("SELECT * FROM vcf", _A, _VCF, recursive=True),
    "vcf_sequences": q("SELECT 'ravel.' || sv_type || '.' || k AS ID, length(ref) AS ref_len, md5(ref) AS ref_md5, md5(CASE sv_type WHEN 'DEL' THEN ref[1] WHEN 'INS' THEN ref[1] || ins WHEN 'BND' THEN alt ELSE '<' || sv_type || '>' END) AS alt_md5 FROM rt LEFT JOIN ii ON sv_type = 'INS' AND ii.chr = rt.chr AND ii.pos = rt.pos AND ii.sv_len = rt.sv_len AND ii.names = rt.names", _A, _VCF, _SEQ, recursive=True),
    "vcf_sorted": q("SELECT CHROM, POS, ID, row_number() OVER (ORDER BY CHROM, POS, ID) AS line FROM vcf", _A, _VCF, recursive=True),
    "info_parse": q("SELECT ID, abs(sv_len_) AS svlen, end_ AS \"end\", re, svtype, gtc FROM (SELECT ID, coalesce(TRY_CAST(regexp_extract(INFO, 'SVLEN=(-?[0-9]+)', 1) AS BIGINT), 0) AS sv_len_, coalesce(TRY_CAST(regexp_extract(INFO, ';END=([0-9]+)', 1) AS BIGINT), 0) AS end_, CAST(regexp_extract(INFO, ';RE=([0-9]+)', 1) AS BIGINT) AS re, regexp_extract(INFO, 'SVTYPE=(...)', 1) AS svtype, CASE WHEN SAMPLE LIKE '0/1%' THEN 'het' WHEN SAMPLE LIKE '1/1%' THEN 'hom' ELSE 'unknown' END AS gtc FROM vcf)", _A, _VCF, recursive=True),
    "truth_explode": """WITH b AS (SELECT 'chr' || (o_custkey % 3 + 1) AS chr, o_orderkey AS start, o_orderkey + 500 + o_custkey % 50 AS e, o_orderkey % 5 AS k, (o_orderkey // 5) % 4 AS s, o_custkey AS p2 FROM orders),
t AS (SELECT chr, start, e, k, CASE s WHEN 0 THEN 'ff' WHEN 1 THEN 'fr' WHEN 2 THEN 'rf' ELSE 'rr' END AS s, p2, p2 + e - start AS hi FROM b),
f AS (SELECT * FROM (VALUES ('ff', 'S', 'L', 'N[['), ('ff', 'E', 'H', 'N[['), ('fr', 'S', 'L', 'N[['), ('fr', 'S', 'H', '[[N'), ('fr', 'E', 'L', 'N]]'), ('fr', 'E', 'H', ']]N'), ('rf', 'S', 'H', 'N]]'), ('rf', 'S', 'L', ']]N'), ('rf', 'E', 'L', '[[N'), ('rf', 'E', 'H', 'N[['), ('rr', 'S', 'H', 'N]]'), ('rr', 'E', 'L', 'N]]')) v(s, x, y, form))
SELECT 'BND' AS sv_type, chr, CASE WHEN x = 'S' THEN start ELSE e END AS start, CAST(NULL AS BIGINT) AS "end", CAST(NULL AS BIGINT) AS sv_len, 'chr9' AS chr2, CASE WHEN y = 'L' THEN p2 ELSE hi END AS pos2, form FROM t JOIN f USING (s) WHERE k = 4
UNION ALL SELECT CASE k WHEN 0 THEN 'DEL' WHEN 1 THEN 'INS' WHEN 2 THEN 'INV' ELSE 'DUP' END, chr, start, CASE WHEN k <> 1 THEN e END, CASE WHEN k = 1 THEN 12 ELSE e - start + 1 END, NULL, NULL, NULL FROM t WHERE k < 4""",
    "truth_genotypes": "SELECT DISTINCT p AS purity, CASE WHEN p > 80 THEN 'hom' WHEN p > 20 THEN 'het' ELSE 'None' END AS genotype FROM (SELECT CAST(o_orderkey % 101 AS DOUBLE) AS p FROM orders)",
    "truth_match_ins": q("SELECT c.pos, m.chr, m.truth_no FROM mi m JOIN calls c USING (call_id)", _E, _MATCH, recursive=True),
    "truth_match_bnd": q("SELECT c.pos, m.chr, m.chr2, m.truth_no FROM mb m JOIN calls c USING (call_id)", _E, _MATCH, recursive=True),
    "truth_match_overlap": q("SELECT c.pos, m.sv_type, m.chr, m.truth_no FROM mo m JOIN calls c USING (call_id)", _E, _MATCH, recursive=True),
    "truth_match_any": q("SELECT c.pos, c.chr, t.truth_no FROM calls c JOIN truth t ON c.sv_type = 'INS' AND t.sv_type IN ('DEL', 'INV', 'DUP') AND t.chr = c.chr AND abs(c.pos + 1 - t.start) <= 1000 AND least(c.sv_len, t.sv_len) / greatest(c.sv_len, t.sv_len) >= 0.5", _E, recursive=True),
    "abnormal_types": q("SELECT mode, t AS sv_type, count(*) AS n FROM (SELECT mode, types, CASE WHEN mode = 'IID' AND sv_type = 'DUP' THEN 'INS' ELSE sv_type END AS t FROM ev, md) WHERE NOT list_contains(types, t) GROUP BY 1, 2", _E, _SETS, recursive=True),
    "callers_side_by_side": q("SELECT mode, caller, sv_type, side, count(*) AS n, count(*) FILTER (level >= 1) AS hit_1, count(*) FILTER (level >= 2) AS hit_2, round(count(*) FILTER (level >= 1) / count(*), 9) AS rate_1, round(count(*) FILTER (level >= 2) / count(*), 9) AS rate_2 FROM sd GROUP BY 1, 2, 3, 4", _E, _SETS, recursive=True),
    "precision_recall": q("SELECT sv_type, side, count(*) AS n, CAST(sum(CASE WHEN level >= 1 THEN 1 ELSE 0 END) AS BIGINT) AS hit_1, CAST(sum(CASE WHEN level >= 2 THEN 1 ELSE 0 END) AS BIGINT) AS hit_2, round(sum(CASE WHEN level >= 1 THEN 1 ELSE 0 END) / count(*), 9) AS rate_1, round(sum(CASE WHEN level >= 2 THEN 1 ELSE 0 END) / count(*), 9) AS rate_2 FROM (SELECT c.sv_type, 'precision' AS side, coalesce((SELECT max(level) FROM ml WHERE ml.call_id = c.call_id), 0) AS level FROM calls c UNION ALL SELECT t.sv_type, 'recall', coalesce((SELECT max(level) FROM ml WHERE ml.truth_no = t.truth_no), 0) FROM truth t) GROUP BY 1, 2", _E, _MATCH, recursive=True),
    "contig_offsets": "SELECT n_name AS chr, CAST(n_nationkey * 1000 + 500 AS BIGINT) AS length, CAST(coalesce(sum(n_nationkey * 1000 + 500) OVER (ORDER BY n_name ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM nation",
    "allele_sequence": "SELECT 'b' || item_id AS chr, item_id % 7 + 3 AS pos, substring(text, CAST(item_id % 7 + 3 AS BIGINT), 8) AS ref FROM benchmark",
    "inserted_sequence": "SELECT item_id, substring(CASE WHEN item_id % 2 = 0 THEN text ELSE reverse(translate(text, 'ACGTacgt', 'TGCAtgca')) END, CAST(item_id % 5 + 1 AS BIGINT), 6) AS ins_seq FROM benchmark",
    "deletion_calls": q("SELECT chr, pos, sv_len, support, cipos, cilen, dr, gt, pl, gq, qual FROM geno WHERE sv_type = 'DEL'", _A, recursive=True),
    "sv_calls_end_to_end": q("SELECT sv_type, chr, pos, sv_len, chr2, pos2, orient, alt, support, cipos, cilen, dr, gt, pl, gq, qual FROM geno", _A, recursive=True),
}

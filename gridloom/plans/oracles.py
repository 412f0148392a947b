"""DuckDB SQL for the registered queries: patterns in closed form, islands and joins written again."""

from __future__ import annotations


def _l(n: str) -> str:
    return f"chr(CAST(64 + {n} AS INTEGER))"


_CELLS = f"""
s AS (SELECT o_custkey AS c, year(o_orderdate) AS y, month(o_orderdate) AS m, CAST(sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS BIGINT) AS cents
      FROM orders GROUP BY 1, 2, 3),
months AS (SELECT e.c, e.y, e.m, (e.c + e.y) % 10 AS k, e.m + 1 AS col, e.y - 1995 AS i, coalesce(cents, 0) AS v
           FROM (SELECT c_custkey AS c, y, m FROM customer, range(1995, 2002) t(y), range(1, 13) u(m)) e
           LEFT JOIN s ON s.c = e.c AND s.y = e.y AND s.m = e.m),
cells AS (
  SELECT CAST(c AS VARCHAR) AS workbook, 'Model' AS sheet, 0 AS sheet_idx, 14 + i AS row, col,
         CASE WHEN m = 1 OR (m = 7 AND k = 0) THEN NULL WHEN m = 7 AND k = 1 THEN '=' || {_l('col - 1')} || (14 + i) || '*(1+B$1)'
              WHEN m = 7 AND k = 2 THEN '=' || {_l('col - 1')} || (14 + i) || '*2' WHEN m = 7 AND k = 4 THEN '=' || {_l('col - 1')} || (14 + i) || '*('
              ELSE '=' || {_l('col - 1')} || (14 + i) || '*(1+$B$1)' END AS formula,
         CASE WHEN m = 1 OR (m = 7 AND k = 0) THEN CAST(v AS DOUBLE) END AS num, CAST(NULL AS VARCHAR) AS txt,
         CASE WHEN m = 1 OR (m = 7 AND k IN (0, 4)) THEN NULL WHEN m = 7 AND k = 1 THEN '(R[0]C[-1]*(1+R1C[-6]))'
              WHEN m = 7 AND k = 2 THEN '(R[0]C[-1]*2)' ELSE '(R[0]C[-1]*(1+R1C2))' END AS pattern,
         m = 7 AND k = 4 AS err
  FROM months WHERE NOT (m = 7 AND k = 3)
  UNION ALL SELECT CAST(c AS VARCHAR), 'Rolling', 1, 4 + 2 * i, col, NULL, CAST(v AS DOUBLE), NULL, NULL, false FROM months WHERE NOT (m = 5 AND k = 5)
  UNION ALL SELECT CAST(c AS VARCHAR), 'Rolling', 1, 5 + 2 * i, col,
         '=SUM(' || {_l('CASE WHEN k = 6 AND m = 8 THEN col - 1 ELSE col - 2 END')} || (4 + 2 * i) || ':' || {_l('col')} || (4 + 2 * i) || ')', NULL, NULL,
         CASE WHEN k = 6 AND m = 8 THEN 'SUM(R[-1]C[-1]:R[-1]C[0])' ELSE 'SUM(R[-1]C[-2]:R[-1]C[0])' END, false FROM months WHERE m >= 3
  UNION ALL SELECT CAST(c AS VARCHAR), 'Model', 0, 14 + i, 1, NULL, NULL, 'Y' || y, NULL, false FROM months WHERE m = 1
  UNION ALL SELECT CAST(c AS VARCHAR), 'Model', 0, 1, 2, NULL, 0.05, NULL, NULL, false FROM months WHERE m = 1 AND y = 1995
  UNION ALL SELECT CAST(c AS VARCHAR), 'Model', 0, 13, col, NULL, NULL, 'M' || lpad(CAST(m AS VARCHAR), 2, '0'), NULL, false FROM months WHERE y = 1995)"""

_BLOCKS = f"""
beside AS (SELECT *, lag(pattern) OVER w AS lp, lag(col) OVER w AS lc FROM cells WINDOW w AS (PARTITION BY workbook, sheet, row ORDER BY col)),
numbered AS (SELECT *, sum(CASE WHEN pattern IS NOT NULL AND (lp IS DISTINCT FROM pattern OR lc <> col - 1) THEN 1 ELSE 0 END)
             OVER (PARTITION BY workbook, sheet, row ORDER BY col ROWS UNBOUNDED PRECEDING) AS run FROM beside),
runs AS (SELECT workbook, sheet, sheet_idx, row, run, pattern, min(col) AS c0, max(col) AS c1, count(*) AS n_cells
         FROM numbered WHERE pattern IS NOT NULL GROUP BY ALL),
blk AS (SELECT *, {_l('c0')} || row || ':' || {_l('c1')} || row AS span FROM runs WHERE n_cells >= 3)"""

#: Longest common subsequence of a and b, as a fold over rows.
_LCS = """list_reduce(string_split(a, ''), lambda acc, ch: list_transform(range(1, length(b) + 1), lambda j: list_max(
  list_transform(range(1, j + 1), lambda k: greatest(acc[k], (CASE WHEN k > 1 THEN acc[k - 1] ELSE 0 END)
    + (CASE WHEN substr(b, k, 1) = ch THEN 1 ELSE 0 END))))),
  list_transform(range(1, length(b) + 1), lambda x: 0::BIGINT))[length(b)]"""
_RATIO = f"200.0 * {_LCS} / (length(a) + length(b))"

_NEIGHBORS = f"""
near AS (SELECT b.*, x.col AS n_col, x.pattern AS n_pattern, x.err, x.num, x.txt, x.formula AS n_formula, CASE WHEN x.col < c0 THEN 'left' ELSE 'right' END AS side,
                sheet || '!' || {_l('x.col')} || row AS cell
         FROM blk b JOIN cells x USING (workbook, sheet, row) WHERE x.col = c0 - 1 OR x.col = c1 + 1),
pairs AS (SELECT DISTINCT pattern AS a, n_pattern AS b FROM near WHERE n_pattern IS NOT NULL),
sims AS (SELECT a, b, {_RATIO} AS similarity FROM pairs),
nb AS (SELECT near.*, similarity, CASE WHEN err THEN 'unparseable' WHEN similarity >= 85 THEN 'near_miss' WHEN n_pattern IS NOT NULL THEN 'different_formula'
              WHEN n_formula IS NULL AND num IS NULL AND txt IS NULL THEN 'blank' ELSE 'literal' END AS kind
       FROM near LEFT JOIN sims ON a = pattern AND b = n_pattern)"""

_SHOWN = "CASE WHEN num = floor(num) THEN format('{:,}', CAST(num AS BIGINT)) ELSE CAST(num AS VARCHAR) END"

_RULES = f"""
lit AS (SELECT workbook, sheet, row, n_col AS col, cell, count(*) AS n, count(DISTINCT pattern) AS np, any_value({_SHOWN}) AS shown,
               list(sheet || '!' || span ORDER BY c0) AS spans, list(pattern ORDER BY c0) AS pats FROM nb WHERE kind = 'literal' GROUP BY ALL),
form AS (SELECT * FROM nb WHERE kind IN ('different_formula', 'near_miss')),
bound AS (SELECT workbook, sheet, row, n_col AS col, cell, count(*) AS n, count(DISTINCT pattern) AS np, list(sheet || '!' || span ORDER BY c0) AS spans, any_value(pattern) AS pat
          FROM form WHERE pattern = 'SUM(R[-1]C[-2]:R[-1]C[0])' AND n_pattern = 'SUM(R[-1]C[-1]:R[-1]C[0])' GROUP BY ALL),
drift AS (SELECT workbook, sheet, row, n_col AS col, cell, count(*) AS n, count(DISTINCT pattern) AS np, list(sheet || '!' || span ORDER BY c0) AS spans, any_value(pattern) AS pat
          FROM form WHERE pattern = '(R[0]C[-1]*(1+R1C2))' AND n_pattern = '(R[0]C[-1]*(1+R1C[-6]))' GROUP BY ALL),
member AS (SELECT b.*, c.col FROM blk b JOIN cells c USING (workbook, sheet, row) WHERE c.col BETWEEN c0 AND c1),
prec AS (SELECT *, row AS p_row, col - 1 AS p_col, 0 AS ord FROM member WHERE sheet = 'Model'
         UNION ALL SELECT *, 1, 2, 1 FROM member WHERE sheet = 'Model' AND pattern LIKE '%R1C%'
         UNION ALL SELECT m.*, row - 1, col - d, 2 - d FROM member m, range(0, 3) t(d) WHERE sheet = 'Rolling' AND (d < 2 OR pattern = 'SUM(R[-1]C[-2]:R[-1]C[0])')),
blanks AS (SELECT workbook, sheet, row, col, c0, pattern, span, n_cells, count(*) AS n_blank, string_agg(sheet || '!' || {_l('p_col')} || p_row, ', ' ORDER BY ord) AS names
           FROM prec p WHERE NOT EXISTS (SELECT 1 FROM cells x WHERE x.workbook = p.workbook AND x.sheet = p.sheet AND x.row = p.p_row AND x.col = p.p_col) GROUP BY ALL),
affected AS (SELECT *, count(*) OVER (PARTITION BY workbook, sheet, row, c0) AS a FROM blanks),
blank AS (SELECT *, n_cells - a AS clean, sheet || '!' || {_l('col')} || row AS cell FROM affected WHERE n_cells > a),
lit_i AS (SELECT workbook, sheet, row, col, cell, CASE WHEN n = 2 AND np = 1 THEN 'high' ELSE 'medium' END AS severity, 'literal-in-formula-block' AS rule_id,
  cell || ' holds the hardcoded value ' || shown || CASE WHEN n = 2 AND np = 1 THEN ' in the middle of formulas that are otherwise alike: ' || spans[1] || ' and ' || spans[2] || ' both follow ' || pats[1] || '.'
    WHEN n = 2 THEN ' between two blocks of different formulas: ' || spans[1] || ' follows ' || pats[1] || ', ' || spans[2] || ' follows ' || pats[2] || '.'
    ELSE ' right beside the formulas ' || spans[1] || ', which follow ' || pats[1] || '.' END AS explanation FROM lit),
bound_i AS (SELECT workbook, sheet, row, col, cell, CASE WHEN n = 2 AND np = 1 THEN 'high' ELSE 'medium' END AS severity, 'range-boundary-mismatch' AS rule_id,
  cell || ' has a range that covers 2 cells, while the formulas in ' || array_to_string(spans, ' and ') || ' cover 3 cells each: it starts one column short of where theirs do (pattern ' || pat || ').' AS explanation FROM bound),
drift_i AS (SELECT workbook, sheet, row, col, cell, CASE WHEN n = 2 AND np = 1 THEN 'high' ELSE 'medium' END AS severity, 'inconsistent-anchoring' AS rule_id,
  cell || ': the col axis of its reference to B1 is relative (B$1) instead of absolute ($B$1), unlike the formulas in ' || array_to_string(spans, ' and ') || ' (pattern ' || pat || ').' AS explanation FROM drift),
blank_i AS (SELECT workbook, sheet, row, col, cell, CASE WHEN clean > a THEN 'high' ELSE 'medium' END AS severity, 'reference-to-blank' AS rule_id,
  cell || CASE WHEN n_blank = 1 THEN ' refers to a blank cell (' ELSE ' refers to blank cells (' END || names || '), but ' || clean || CASE WHEN clean = 1 THEN ' other cell in ' ELSE ' other cells in ' END
    || sheet || '!' || span || ' (pattern ' || pattern || ') refer to filled ones; only ' || a || ' of ' || n_cells || ' members lack data.' AS explanation FROM blank),
issues AS (SELECT * FROM lit_i UNION ALL SELECT * FROM bound_i UNION ALL SELECT * FROM drift_i UNION ALL SELECT * FROM blank_i),
rk AS (SELECT *, row_number() OVER (PARTITION BY workbook ORDER BY severity, rule_id, cell) AS rank FROM issues)"""

_TRUTH = f"""
truth AS (
  SELECT CAST(c AS VARCHAR) AS workbook, 'Model!' || {_l('col')} || (14 + i) AS cell,
         CASE WHEN m = 1 THEN 'known_intentional' WHEN m = 7 AND k = 2 THEN 'ambiguous' ELSE 'injected_bug' END AS state,
         CASE WHEN m = 1 THEN NULL WHEN m = 7 AND k IN (0, 4) THEN 'literal-in-formula-block' WHEN m = 7 AND k = 1 THEN 'inconsistent-anchoring'
              WHEN m = 7 AND k = 2 THEN 'range-boundary-mismatch' ELSE 'reference-to-blank' END AS rule
  FROM months WHERE m = 1 OR (m = 7 AND k IN (0, 1, 2, 4)) OR (m = 8 AND k = 3)
  UNION ALL SELECT CAST(c AS VARCHAR), 'Rolling!' || {_l('col')} || (5 + 2 * i), 'injected_bug', CASE WHEN k = 5 THEN 'reference-to-blank' ELSE 'range-boundary-mismatch' END
  FROM months WHERE (k = 5 AND m IN (5, 6, 7)) OR (k = 6 AND m = 8)),
scored AS (SELECT issues.*, CASE WHEN state = 'injected_bug' AND rule = rule_id THEN 'true_positive' WHEN state = 'known_intentional' THEN 'known_intentional'
                  WHEN state = 'ambiguous' THEN 'ambiguous_excluded' ELSE 'false_positive' END AS outcome FROM issues LEFT JOIN truth USING (workbook, cell)),
missed AS (SELECT workbook, cell, rule AS rule_id FROM truth t WHERE state = 'injected_bug' AND NOT EXISTS (SELECT 1 FROM issues x WHERE x.workbook = t.workbook AND x.cell = t.cell AND x.rule_id = t.rule)),
grid AS (SELECT * FROM (VALUES ('literal-in-formula-block'), ('range-boundary-mismatch'), ('reference-to-blank'), ('inconsistent-anchoring')) r(rule_id), (VALUES ('high'), ('medium')) t(severity)),
slices AS (SELECT rule_id, severity, count(*) FILTER (outcome = 'true_positive') AS tp, count(*) FILTER (outcome = 'false_positive') AS fp,
                  count(*) FILTER (outcome = 'known_intentional') AS known, count(*) FILTER (outcome = 'ambiguous_excluded') AS ambiguous
           FROM grid LEFT JOIN scored USING (rule_id, severity) GROUP BY ALL),
topk AS (SELECT rule_id, outcome, row_number() OVER (PARTITION BY rule_id ORDER BY severity, workbook, cell) AS rn FROM scored WHERE outcome IN ('true_positive', 'false_positive')),
atk AS (SELECT rule_id, count(*) FILTER (outcome = 'true_positive') / count(*) AS p_at_k, count(*) AS k FROM topk WHERE rn <= 10 GROUP BY 1),
rolled AS (SELECT rule_id, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(known) AS BIGINT) AS known, CAST(sum(ambiguous) AS BIGINT) AS ambiguous, coalesce(any_value(fn), 0) AS fn
           FROM slices LEFT JOIN (SELECT rule_id, count(*) AS fn FROM missed GROUP BY 1) USING (rule_id) GROUP BY 1),
rollups AS (SELECT rule_id, tp, fp, known, ambiguous, fn, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall, p_at_k, k FROM rolled LEFT JOIN atk USING (rule_id))"""

_CANDIDATES = f"""
cand AS (SELECT b.workbook, b.sheet, b.row, b.c0, b.span, b.pattern, b.sheet || '!' || {_l('c.col')} || b.row AS cell, c.col AS ord FROM blk b JOIN cells c USING (workbook, sheet, row) WHERE c.col BETWEEN c0 AND c1
         UNION ALL SELECT workbook, sheet, row, c0, span, pattern, cell, CASE WHEN kind = 'near_miss' THEN 2000000 ELSE 1000000 END + n_col FROM nb),
flagged AS (SELECT DISTINCT workbook, cell, true AS flagged FROM issues),
ranked AS (SELECT cand.*, CASE WHEN state = 'injected_bug' AND flagged THEN 1 WHEN state = 'ambiguous' AND flagged THEN 2 WHEN state = 'known_intentional' THEN 3 END AS r, state, rule
           FROM cand LEFT JOIN truth USING (workbook, cell) LEFT JOIN flagged USING (workbook, cell)),
labelled AS (SELECT workbook, sheet, row, c0, span, pattern, min(CASE WHEN r IS NOT NULL THEN {{'r': r, 'ord': ord, 'basis': state || CASE WHEN r < 3 THEN ':' || rule ELSE '' END || '@' || cell}} END) AS best FROM ranked GROUP BY ALL),
labels_ AS (SELECT workbook, sheet, row, c0, span, pattern, CASE best.r WHEN 1 THEN 'suspected_error' WHEN 2 THEN 'unknown' WHEN 3 THEN 'intentional_override' END AS label, coalesce(best.basis, 'no_ground_truth_signal') AS basis FROM labelled)"""

_B = f"WITH {_CELLS}, {_BLOCKS}"
_N = f"{_B}, {_NEIGHBORS}"
_I = f"{_N}, {_RULES}"
_T = f"{_I}, {_TRUTH}"
_C = f"{_T}, {_CANDIDATES}"

_FORMULAS = """
WITH f AS (SELECT p_partkey AS row, CASE p_partkey % 6 WHEN 0 THEN '=LET(x, ' || p_size || ', x*2)' WHEN 1 THEN '=SUM(Table1[Column1])' WHEN 2 THEN '=lambda(x,x)(' || p_size || ')'
  WHEN 3 THEN '=A1*' || p_size WHEN 4 THEN '=LET(a,T' || p_size || '[b],a)' ELSE '=Sheet' || p_size || '!A1+''My Tab''!B2+Data!C3+Sheet' || p_size || '!D4&"x!"' END AS formula, p_brand AS workbook, p_size FROM part)"""

_EDGES = """
edges AS (SELECT workbook, sheet AS p_sheet, row AS p_row, col - 1 AS p_col, sheet, row, col, 0 AS ord FROM cells WHERE sheet = 'Model' AND formula IS NOT NULL AND NOT err
  UNION ALL SELECT workbook, sheet, 1, 2, sheet, row, col, 1 FROM cells WHERE sheet = 'Model' AND formula LIKE '%(1+%'
  UNION ALL SELECT workbook, sheet, row - 1, col - d, sheet, row, col, 2 - d FROM cells, range(0, 3) t(d) WHERE sheet = 'Rolling' AND formula IS NOT NULL AND (d < 2 OR pattern = 'SUM(R[-1]C[-2]:R[-1]C[0])'))"""

_JUDGED = """WITH judged AS (SELECT CASE WHEN quality = 1 THEN 'suspected_error' ELSE 'subtotal' END AS label, CASE WHEN n_chars > 500 THEN 'suspected_error' ELSE 'subtotal' END AS predicted
  FROM labels JOIN documents USING (doc_id)), l AS (SELECT * FROM (VALUES ('subtotal'), ('intentional_override'), ('suspected_error'), ('unknown')) t(label))"""


def _issue(name: str) -> str:
    return f"{_I} SELECT workbook, cell, severity, explanation FROM {name}"


_FILES = """WITH book AS (SELECT n_name, CAST(n_nationkey AS INTEGER) AS n, n_regionkey || '/book' || (n_nationkey % 3)
          || CASE n_nationkey % 4 WHEN 0 THEN '' WHEN 1 THEN '.XLSX' WHEN 2 THEN '.xlsm' ELSE '.Xlsm' END AS workbook FROM nation)"""

ORACLES = {
    "src_dense_grid": f"""WITH {_CELLS} SELECT workbook, sheet, max(row) * max(col) AS n_cells, max(row) * max(col) - count(*) AS n_blank FROM cells GROUP BY 1, 2""",
    "src_skip_log": f"""{_FORMULAS} SELECT workbook, row, 'LET or LAMBDA' AS reason FROM f WHERE row % 6 IN (0, 2, 4) UNION ALL SELECT workbook, row, 'structured reference' FROM f WHERE row % 6 IN (1, 4)""",
    "src_cross_sheet_refs": f"""{_FORMULAS} SELECT row, CASE WHEN row % 6 = 5 THEN 'Sheet' || p_size || ',My Tab,x' ELSE '' END AS refs FROM f""",
    "src_merged_membership": """SELECT c_custkey AS row, c_nationkey + 1 AS col, EXISTS (SELECT 1 FROM nation WHERE c_custkey BETWEEN n_nationkey * 40 AND n_nationkey * 40 + 55
        AND c_nationkey + 1 BETWEEN n_nationkey AND n_nationkey + 3) AS merged FROM customer""",
    "fn_addr_parts": """SELECT p_partkey, p_partkey % 2 = 0 AS col_abs, CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(65 + (n - 27) // 26) || chr(65 + (n - 1) % 26)
        ELSE chr(65 + (n - 703) // 676) || chr(65 + ((n - 703) // 26) % 26) || chr(65 + (n - 1) % 26) END AS col_letters, p_partkey % 3 = 0 AS row_abs, p_partkey AS row_number
        FROM (SELECT p_partkey, CAST(p_size * 300 AS INTEGER) AS n FROM part)""",
    "fn_col_letters": """SELECT c_custkey, CASE WHEN n <= 26 THEN chr(64 + n) WHEN n <= 702 THEN chr(65 + (n - 27) // 26) || chr(65 + (n - 1) % 26)
        ELSE chr(65 + (n - 703) // 676) || chr(65 + ((n - 703) // 26) % 26) || chr(65 + (n - 1) % 26) END AS letters, n FROM (SELECT c_custkey, CAST(c_custkey % 16384 + 1 AS INTEGER) AS n FROM customer)""",
    "fn_r1c1": f"WITH {_CELLS} SELECT workbook, sheet, row, col, formula, pattern FROM cells WHERE formula IS NOT NULL",
    "fn_parse_errors": """SELECT p_partkey, replace(list_extract(['=LET(x,{0},x)', '=SUM(T{0}[c])', '{=A{0}}', '=A:A', '={0}:{0}', '=Sheet1:Sheet3!A{0}', '=A{0}%', '=SUM(A{0},B1', '=A{0}+', '=LOG10(A{0})', '=IF(A{0},,0)', '=A{0}*(1+$B$1)'],
        CAST(p_partkey % 12 + 1 AS INTEGER)), '{0}', CAST(p_size AS VARCHAR)) AS formula, CASE WHEN p_partkey % 12 < 7 THEN 'unsupported' WHEN p_partkey % 12 < 11 THEN 'syntax' END AS error_kind,
        CASE WHEN p_partkey % 12 = 11 THEN '(R[' || (p_size - p_partkey) || ']C[-2]*(1+R1C2))' END AS pattern FROM part""",
    "fn_similarity": f"SELECT a AS p_brand, b AS p_type, round({_RATIO}, 4) AS ratio FROM (SELECT DISTINCT p_brand AS a, p_type AS b FROM part)",
    "fn_guess_shape": """WITH p AS (SELECT DISTINCT l_orderkey % 4 AS k, l_linenumber AS n, l_linenumber - 4 AS a, CAST(l_quantity AS INTEGER) % 5 - 2 AS b, l_suppkey % 4 - 2 AS c FROM lineitem)
        SELECT DISTINCT CASE k WHEN 0 THEN '(R[' || a || ']C[0]-R[' || b || ']C[0])' WHEN 1 THEN 'SUM(R[' || a || ']C[' || b || ']:R[' || c || ']C[' || a || '])'
          WHEN 2 THEN '(R[0]C[' || b || ']*(1+R' || n || 'C[' || c || ']))' ELSE '(R[' || a || ']C1*2)' END AS pattern,
        CASE WHEN k = 0 AND a <> b THEN 'variance' WHEN k = 1 AND b = a THEN 'category_total' WHEN k = 1 AND a = c THEN 'trailing_sum' WHEN k = 2 AND b = -1 THEN 'growth_chain' ELSE 'unrecognized' END AS shape FROM p""",
    "fn_block_signature": f"""{_N}, dev AS (SELECT workbook, sheet, row, c0, string_agg('  - ' || cell || ' (' || CASE WHEN kind = 'near_miss' THEN kind ELSE 'non_conforming:' || kind END || ', neighbor)', chr(10)
          ORDER BY kind = 'near_miss', n_col) AS d FROM nb GROUP BY ALL),
        t AS (SELECT workbook, sheet, span, CASE WHEN pattern = '(R[0]C[-1]*(1+R1C2))' THEN 'growth_chain' ELSE 'trailing_sum' END AS base_shape, pattern, n_cells, d FROM blk LEFT JOIN dev USING (workbook, sheet, row, c0))
        SELECT workbook, sheet, span, base_shape, sha256('Block: ' || sheet || '!' || span || chr(10) || 'Base shape: ' || base_shape || chr(10) || 'Formula pattern: ' || pattern || chr(10)
          || 'Conforming cells: ' || n_cells || chr(10) || CASE WHEN d IS NULL THEN 'Deviations: none' ELSE 'Deviations:' || chr(10) || d END) AS signature FROM t""",
    "gr_edges": f"WITH {_CELLS}, {_EDGES} SELECT workbook, p_sheet, p_row, p_col, count(*) AS n_dependents FROM edges GROUP BY ALL",
    "gr_precedents": f"WITH {_CELLS}, {_EDGES} SELECT workbook, sheet, row, col, string_agg({_l('p_col')} || p_row, ',' ORDER BY ord) AS precedents FROM edges GROUP BY ALL",
    "gr_nodes_empty": f"""WITH {_CELLS}, {_EDGES}, n AS (SELECT workbook, sheet, row, col FROM cells WHERE formula IS NOT NULL UNION SELECT workbook, p_sheet, p_row, p_col FROM edges)
        SELECT workbook, sheet, count(*) AS n_nodes, count(*) FILTER (c.col IS NULL) AS n_empty, count(*) FILTER (c.err) AS n_errors FROM n LEFT JOIN cells c USING (workbook, sheet, row, col) GROUP BY 1, 2""",
    "gr_named_ranges": """WITH u AS (SELECT s_suppkey AS row, CASE WHEN s_suppkey % 2 = 0 THEN 'Model' ELSE 'Other' END AS host, s_suppkey % 3 = 0 AS qualified, s_nationkey AS n FROM supplier),
        v AS (SELECT row, n, n % 5 = 0 AND (qualified OR host = 'Model') AS own, host, qualified, n % 7 <> 3 AND NOT qualified AS wide FROM u WHERE n IN (SELECT n_nationkey FROM nation))
        SELECT row, CASE WHEN own THEN host || '!D' || (n + 1) || ':D' || (n + 1) WHEN NOT wide THEN 'not defined' WHEN n % 6 = 5 THEN 'its target is no cell or range'
          ELSE 'Data!B' || (n + 1) || ':C' || (n + 2) END AS target FROM v""",
    "gr_topo_levels": "SELECT 'T!A' || s_suppkey AS cell, CAST(floor(log2(s_suppkey)) AS BIGINT) AS level FROM supplier WHERE s_suppkey >= 1 AND (SELECT count(*) FROM supplier) > 1",
    "gr_cycles": """WITH RECURSIVE e AS (SELECT CAST((n_nationkey * 7 + 3) % 25 + 10 AS INTEGER) AS a, CAST(n_nationkey + 10 AS INTEGER) AS b FROM nation),
        w AS (SELECT a AS first, b AS here, ['T!A' || a] AS path, b = a AS closed FROM e
              UNION ALL SELECT first, e.b, list_append(path, 'T!A' || here), e.b = first FROM w JOIN e ON e.a = w.here
              WHERE NOT closed AND e.b >= first AND here > first AND NOT list_contains(path, 'T!A' || here))
        SELECT array_to_string(path, '>') AS cycle FROM w WHERE closed""",
    "bk_runs": f"{_B} SELECT pattern, n_cells AS length, count(*) AS n_runs FROM runs GROUP BY 1, 2",
    "bk_blocks": f"{_B} SELECT workbook, sheet, sheet_idx, row, span, pattern, n_cells, CASE WHEN sheet = 'Model' THEN 'Y' || (1995 + row - 14) END AS row_label FROM blk",
    "bk_neighbors": f"{_N} SELECT workbook, cell, span, side, kind, round(similarity, 4) AS similarity FROM nb",
    "bk_labels": f"{_B} SELECT workbook, sheet, span, string_agg(CASE WHEN sheet = 'Model' AND row = 14 THEN 'M' || lpad(CAST(j - 1 AS VARCHAR), 2, '0') ELSE '-' END, ',' ORDER BY j) AS col_labels FROM blk, range(1, 20) t(j) WHERE j BETWEEN c0 AND c1 GROUP BY ALL",
    "rl_literal": _issue("lit_i"),
    "rl_range_boundary": _issue("bound_i"),
    "rl_reference_to_blank": _issue("blank_i"),
    "rl_anchoring": _issue("drift_i"),
    "rl_all_issues": f"{_I} SELECT workbook, cell, severity, rule_id FROM issues",
    "rk_ranked_issues": f"{_I} SELECT workbook, rank, cell, severity, rule_id FROM rk",
    "ag_heatmap": f"{_I} SELECT workbook, cell, min(severity) AS severity, count(*) AS issue_count, string_agg(rule_id, ',' ORDER BY rank) AS rule_ids FROM rk GROUP BY 1, 2",
    "ag_heatmap_bbox": f"{_I} SELECT workbook, sheet, min(row) AS row0, max(row) AS row1, min(col) AS col0, max(col) AS col1 FROM rk GROUP BY 1, 2",
    "ag_counts": f"{_I} SELECT workbook, severity, rule_id, count(*) AS n FROM issues GROUP BY ALL",
    "ev_outcomes": f"{_T} SELECT workbook, cell, rule_id, outcome FROM scored",
    "ev_slices": f"{_T} SELECT *, tp / nullif(tp + fp, 0) AS precision FROM slices",
    "ev_false_negatives": f"{_T} SELECT * FROM missed",
    "ev_rollups": f"{_T} SELECT * FROM rollups",
    "ev_precision_at_10": f"{_T} SELECT * FROM atk",
    "ev_micro_average": f"{_T} SELECT sum(tp) / nullif(sum(tp) + sum(fp), 0) AS precision, sum(tp) / nullif(sum(tp) + sum(fn), 0) AS recall, sum(round(p_at_k * k)) / nullif(sum(k), 0) AS p_at_k FROM rollups",
    "ev_clean_baseline": f"""{_T}, clean AS (SELECT workbook FROM truth GROUP BY 1 HAVING NOT bool_or(state = 'injected_bug'))
        SELECT (SELECT count(*) FROM clean) AS entries, count(*) FILTER (outcome <> 'true_positive') AS raw_flags, count(*) FILTER (outcome = 'false_positive') AS unexplained FROM scored WHERE workbook IN (SELECT workbook FROM clean)""",
    "lb_labels": f"{_C} SELECT workbook, sheet, span, label, basis FROM labels_",
    # the seeded shuffle (Mersenne Twister, seed 42) of the 25 names
    "lb_split": """SELECT 'NATION_' || k AS workbook, part FROM (VALUES ('23', 'train'), ('2', 'train'), ('17', 'train'), ('4', 'train'), ('3', 'train'), ('14', 'train'), ('13', 'train'), ('18', 'train'), ('22', 'train'), ('6', 'train'), ('19', 'train'), ('24', 'train'), ('1', 'train'), ('21', 'train'), ('7', 'train'), ('20', 'train'), ('10', 'train'), ('8', 'train'), ('12', 'val'), ('9', 'val'), ('15', 'val'), ('16', 'val'), ('0', 'test'), ('11', 'test'), ('5', 'test')) t(k, part)""",
    "src_workbook_cells": f"""{_FILES}, size AS (SELECT * FROM (VALUES ('Data', 0, 3, 4), ('Other tab', 1, 2, 1)) t(sheet, sheet_idx, rows, cols)),
        grid AS (SELECT book.*, sheet, sheet_idx, r.row, c.col FROM book, size, range(1, 4) r(row), range(1, 5) c(col) WHERE r.row <= rows AND c.col <= cols)
        SELECT workbook, sheet, sheet_idx, CAST(row AS INTEGER) AS row, CAST(col AS INTEGER) AS col,
          CASE WHEN sheet = 'Data' AND row = 3 AND col = 4 THEN '=LET(a,1,a)' WHEN sheet = 'Other tab' AND row = 2 THEN '=Data!A' || (n + 1) END AS formula,
          CASE WHEN sheet = 'Data' AND row = 1 AND col = 1 THEN 'str' WHEN sheet = 'Data' AND row = 1 AND col = 3 THEN 'num' WHEN sheet = 'Data' AND row = 3 AND col = 1 THEN 'bool' END AS value_type,
          CASE WHEN sheet = 'Data' AND row = 1 AND col = 3 THEN n * 1.5::DOUBLE END AS value_num, CASE WHEN sheet = 'Data' AND row = 1 AND col = 1 THEN n_name END AS value_str,
          CASE WHEN sheet = 'Data' AND row = 3 AND col = 1 THEN n % 2 = 0 END AS value_bool, sheet = 'Data' AND row <= 2 AND col <= 2 AS merged FROM grid""",
    "src_named_ranges": f"""{_FILES} SELECT workbook, 'rate_' || n AS name, 'Data!$A$' || (n + 1) AS refers_to, 'workbook' AS scope FROM book UNION ALL SELECT workbook, 'own', '$B$2', 'Other tab' FROM book""",
    "src_file_skips": f"""{_FILES} SELECT workbook, 'Data' AS sheet, CAST(3 AS INTEGER) AS row, CAST(4 AS INTEGER) AS col, 'LET or LAMBDA' AS reason FROM book""",
    "src_file_merges": f"""{_FILES} SELECT workbook, 'Data' AS sheet, CAST(1 AS INTEGER) AS r0, CAST(1 AS INTEGER) AS c0, CAST(2 AS INTEGER) AS r1, CAST(2 AS INTEGER) AS c1 FROM book""",
    "fn_literals": """WITH p AS (SELECT DISTINCT p_partkey % 8 AS k, CASE WHEN p_partkey % 8 = 4 THEN 0 ELSE p_size END AS z FROM part)
        SELECT CASE k WHEN 0 THEN '=A1*' || z || '.50' WHEN 1 THEN '=A1*' || z || 'E3' WHEN 2 THEN '=A1*0.0' || z WHEN 3 THEN '=A1&"' || z || '""q"' || '""' WHEN 4 THEN '=IF(true,"",FALSE)'
            WHEN 5 THEN '=A1*' || z || 'e-2' WHEN 6 THEN '=A1*1234567890123456' || z ELSE '=-A1^+' || z END AS formula,
          CASE k WHEN 0 THEN '(R[0]C[-1]*' || z || '.5)' WHEN 1 THEN '(R[0]C[-1]*' || z || '000)' WHEN 2 THEN '(R[0]C[-1]*' || rtrim('0.0' || z, '0') || ')' WHEN 3 THEN '(R[0]C[-1]&"' || z || '""q"' || '"")'
            WHEN 4 THEN 'IF(TRUE,"",FALSE)' WHEN 5 THEN '(R[0]C[-1]*' || CASE WHEN z % 100 = 0 THEN CAST(z // 100 AS VARCHAR) ELSE rtrim((z // 100) || '.' || lpad(CAST(z % 100 AS VARCHAR), 2, '0'), '0') END || ')'
            WHEN 6 THEN '(R[0]C[-1]*' || replace(CAST(CAST('1234567890123456' || z AS DOUBLE) AS VARCHAR), 'e+', 'e+') || ')' ELSE '((-R[0]C[-1])^(+' || z || '))' END AS pattern FROM p""",
    "gr_wide_ranges": """SELECT CAST(n_nationkey + 10 AS INTEGER) AS row, 'T' AS p_sheet, CAST(n_nationkey + 1 AS BIGINT) AS n, CAST((n_nationkey + 1) * (n_nationkey + 2) // 2 AS BIGINT) AS rows,
          CAST(4 * (n_nationkey + 1) AS BIGINT) AS cols, CAST(n_nationkey AS BIGINT) AS last FROM nation WHERE n_nationkey > 0
        UNION ALL SELECT 10, 'Wide', 1300000, 32500650000, 17550000, 1299999 FROM nation WHERE n_nationkey = 0""",
    # fixed values: what the generated corpus holds, and what the rules find in it
    "gn_corpus": "SELECT state, n::BIGINT AS n, entries::BIGINT AS entries FROM (VALUES ('subtotal', 510, 60), ('clean', 459, 84), ('injected_bug', 61, 50), ('ambiguous', 45, 20), ('known_intentional', 30, 30)) t(state, n, entries)",
    "ev_corpus": """SELECT rule_id, tp::BIGINT AS tp, fp::BIGINT AS fp, fn::BIGINT AS fn, known::BIGINT AS known, ambiguous::BIGINT AS ambiguous FROM (VALUES ('literal-in-formula-block', 21, 0, 0, 22, 4), ('range-boundary-mismatch', 10, 0, 0, 0, 0), ('reference-to-blank', 20, 0, 0, 0, 39),
        ('inconsistent-anchoring', 10, 0, 0, 0, 2)) t(rule_id, tp, fp, fn, known, ambiguous)""",
    "ev_corpus_baseline": "SELECT 94::BIGINT AS entries, 52::BIGINT AS raw_flags, 0::BIGINT AS unexplained",
    "lb_corpus": "SELECT label, n::BIGINT AS n FROM (VALUES ('subtotal', 60), ('intentional_override', 5), ('suspected_error', 67), ('unknown', 20), (NULL, 10)) t(label, n)",
    "lb_readiness": f"""{_C}, p AS (SELECT label, pattern, CASE WHEN CAST(workbook AS BIGINT) % 10 < 7 THEN 'train' WHEN CAST(workbook AS BIGINT) % 10 = 7 THEN 'val' ELSE 'test' END AS part FROM labels_ WHERE label IS NOT NULL),
        l AS (SELECT * FROM (VALUES ('subtotal'), ('intentional_override'), ('suspected_error'), ('unknown')) t(label))
        SELECT label, count(part) AS n, count(DISTINCT pattern) AS patterns, count(*) FILTER (part = 'train') AS train, count(*) FILTER (part = 'val') AS val, count(*) FILTER (part = 'test') AS test, count(part) >= 50 AS ready
        FROM l LEFT JOIN p USING (label) GROUP BY 1""",
    "ml_suppression": f"""{_C}, q AS (SELECT DISTINCT cand.workbook, cand.cell FROM cand JOIN labels_ USING (workbook, sheet, row, c0) WHERE label = 'intentional_override')
        SELECT rule_id, count(*) AS n, q.cell IS NOT NULL AS suppressed FROM issues LEFT JOIN q USING (workbook, cell) GROUP BY 1, 3""",
    "ml_confusion": f"""{_JUDGED} SELECT label, count(*) FILTER (predicted = 'subtotal') AS subtotal, count(*) FILTER (predicted = 'intentional_override') AS intentional_override,
        count(*) FILTER (predicted = 'suspected_error') AS suspected_error, count(*) FILTER (predicted = 'unknown') AS unknown FROM l LEFT JOIN judged USING (label) GROUP BY 1""",
    "ml_label_metrics": f"""{_JUDGED}, m AS (SELECT l.label, count(*) FILTER (j.label = l.label) AS support, count(*) FILTER (j.label = l.label AND predicted = l.label) AS tp,
          count(*) FILTER (j.label <> l.label AND predicted = l.label) AS fp, count(*) FILTER (j.label = l.label AND predicted <> l.label) AS fn FROM l, judged j GROUP BY 1),
        r AS (SELECT *, tp / nullif(tp + fp, 0) AS precision, tp / nullif(tp + fn, 0) AS recall FROM m)
        SELECT *, CASE WHEN precision > 0 AND recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1 FROM r""",
    "ml_class_weights": f"""{_JUDGED} SELECT label, (SELECT count(*) FROM judged)::DOUBLE / (4 * greatest(count(predicted), 1)) AS weight FROM l LEFT JOIN judged USING (label) GROUP BY 1""",
}

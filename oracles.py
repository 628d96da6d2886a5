"""DuckDB twins of the registered queries (the correctness gate).

Tables ``orders customer nation lineitem part documents labels`` are views
in the checker.  ``CASES`` is the shared case view (FIXTURES.md F5);
``DERIVED`` adds the rule columns.  The rules - bins, keywords, recodes, cuts and
texts - are written out here as SQL, independent of the library's presets and
rule objects, so a wrong value there shows as a difference.
"""

from __future__ import annotations

CASES = """
SELECT o.o_orderkey AS record_id,
       CASE o.o_orderstatus WHEN 'F' THEN 'Yes' WHEN 'O' THEN 'No' END AS outcome,
       p.p_name AS item,
       CAST(p.p_size * 2 AS DOUBLE) AS age,
       o.o_orderpriority AS grp_a,
       c.c_mktsegment AS grp_b,
       n.n_name AS region,
       CAST(coalesce(l.n_lines, 0) AS INTEGER) AS units,
       CAST(year(o.o_orderdate) AS INTEGER) AS year,
       strftime(o.o_orderdate, '%B') AS month,
       o.o_totalprice AS price,
       ['Handgun', 'Rifle', 'Shotgun', 'FIREARM', 'Gun', 'Knife', 'stab wound', 'Cutting tool', 'Blunt Object',
        'Strangulation', 'Poison', 'Unknown', NULL][CAST(l.pk % 13 + 1 AS INTEGER)] AS weapon,
       ['Spouse', 'Common-law spouse', 'Parent', 'Child', 'Sibling', 'In-law', 'Friend', 'Acquaintance', 'Neighbor',
        'Boyfriend/Girlfriend', 'Ex-spouse', 'Stranger', 'spouse', 'Employer', 'Unknown',
        NULL][CAST(o.o_custkey % 16 + 1 AS INTEGER)] AS relation,
       ['Male', 'Female', 'Unknown'][CAST(o.o_orderkey % 3 + 1 AS INTEGER)] AS sex
FROM orders o
JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey
LEFT JOIN (SELECT l_orderkey, min(l_partkey) AS pk, count(*) AS n_lines
           FROM lineitem GROUP BY l_orderkey) l ON o.o_orderkey = l.l_orderkey
LEFT JOIN part p ON l.pk = p.p_partkey
"""

def _weapon_sql(null: str, blunt: str = "Blunt", words=("handgun", "shotgun", "rifle"), more=("stab",), five: bool = True) -> str:
    """Weapon groups by lower-cased substrings, the first that matches."""
    has = lambda *ws: " OR ".join(f"contains(lower(weapon), '{w}')" for w in ws)
    tail = (f"WHEN contains(lower(weapon), 'blunt') THEN '{blunt}' "
            f"WHEN contains(lower(weapon), 'strangulation') THEN 'Strangulation'") if five else ""
    cut = ("cut",) if five else ()
    return (f"CASE WHEN weapon IS NULL THEN '{null}' WHEN {has('firearm', 'gun', *words)} THEN 'Firearm' "
            f"WHEN {has('knife', *cut, *more)} THEN 'Knife' {tail} ELSE 'Other' END")


_D1 = f"""
SELECT *,
       CASE outcome WHEN 'Yes' THEN 1 WHEN 'No' THEN 0 END AS label,
       CASE WHEN age < 18 OR age > 65 THEN 1 ELSE 0 END AS vulnerable,
       CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 18 THEN 'Child' WHEN age < 30 THEN 'Young Adult'
            WHEN age < 50 THEN 'Adult' WHEN age < 65 THEN 'Middle Age' ELSE 'Senior' END AS age_cat,
       CASE WHEN age IS NULL THEN 'Unknown' WHEN age < 18 THEN 'Child' WHEN age < 30 THEN 'Young Adult'
            WHEN age < 50 THEN 'Adult' WHEN age < 65 THEN 'Middle Aged' ELSE 'Senior' END AS age_category,
       CASE WHEN item IS NULL THEN 'Unknown'
            WHEN contains(lower(item), 'bolt') OR contains(lower(item), 'rod') THEN 'Fastener'
            WHEN contains(lower(item), 'gear') OR contains(lower(item), 'gizmo') OR contains(lower(item), 'widget') THEN 'Machine'
            WHEN contains(lower(item), 'plate') OR contains(lower(item), 'ring') THEN 'Plate' ELSE 'Other' END AS item_group,
       {_weapon_sql('Unknown')} AS weapon_group,
       {_weapon_sql('Unknown', 'Blunt Object')} AS weapon_model,
       {_weapon_sql('Other', 'Blunt Object')} AS weapon_service,
       {_weapon_sql('Unknown', words=(), more=(), five=False)} AS weapon_category,
       CASE WHEN grp_b IS NULL THEN 'Unknown' WHEN grp_b IN ('MACHINERY', 'BUILDING', 'AUTOMOBILE') THEN 'Industry'
            WHEN grp_b IN ('HOUSEHOLD', 'FURNITURE') THEN 'Home' ELSE 'Other' END AS grp_b_simple,
       CASE WHEN relation IS NULL THEN 'Unknown'
            WHEN relation IN ('Spouse', 'Common-law spouse', 'Parent', 'Child', 'Sibling', 'In-law') THEN 'Family'
            WHEN relation IN ('Friend', 'Acquaintance', 'Neighbor', 'Boyfriend/Girlfriend', 'Ex-spouse') THEN 'Acquaintance'
            WHEN relation = 'Stranger' THEN 'Stranger' ELSE 'Other' END AS relation_simple,
       CASE month WHEN 'January' THEN 1 WHEN 'February' THEN 2 WHEN 'March' THEN 3 WHEN 'April' THEN 4 WHEN 'May' THEN 5
            WHEN 'June' THEN 6 WHEN 'July' THEN 7 WHEN 'August' THEN 8 WHEN 'September' THEN 9 WHEN 'October' THEN 10
            WHEN 'November' THEN 11 WHEN 'December' THEN 12 END AS month_num
FROM base_cases
"""

DERIVED = f"""
SELECT *, CASE WHEN month_num IN (1, 7, 12) THEN 1 ELSE 0 END AS month_flag FROM ({_D1})
"""


def with_cases(body: str) -> str:
    """Prefix ``body`` with the ``cases`` (derived) CTE."""
    return (f"WITH base_cases AS ({CASES}),\n cases AS ({DERIVED})\n{body}")



def _rank(order: str, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"CAST(row_number() OVER ({p}ORDER BY {order}) AS INTEGER)"


ORACLES: dict[str, str] = {
    # ---------------------------------------------------------- step 1
    "d1_rate_by_item_group": with_cases("""
        SELECT item_group, count(label) AS cases, round_even(avg(label), 3) AS rate
        FROM cases WHERE item_group IS NOT NULL GROUP BY item_group"""),
    # ---------------------------------------------------------- step 2
    "b1_label_map": with_cases("""
        SELECT outcome, label, count(*) AS n FROM cases GROUP BY outcome, label"""),
    "b5_out_of_range_flag": with_cases("SELECT record_id, age, vulnerable FROM cases"),
    "b6_age_bins": with_cases("SELECT record_id, age, age_cat, age_category FROM cases"),
    "b7_keyword_rules": with_cases(
        "SELECT record_id, item, weapon, weapon_group, weapon_model, weapon_service, item_group FROM cases"),
    "b8_keyword_narrow": with_cases(
        f"SELECT record_id, {_weapon_sql('Unknown', 'Blunt Object', words=(), more=())} AS weapon_narrow FROM cases"),
    "b9_keyword3": with_cases("SELECT record_id, weapon_category FROM cases"),
    "b10_recode": with_cases(
        "SELECT record_id, grp_b, relation, grp_b_simple, relation_simple FROM cases"),
    "b11_b12_month": with_cases("SELECT record_id, month, month_num, month_flag FROM cases"),
    "d1_rate_by_region": with_cases("""
        SELECT region, count(label) AS cases, round_even(avg(label), 3) AS rate
        FROM cases WHERE region IS NOT NULL GROUP BY region"""),
    "d1_rate_by_vulnerable": with_cases("""
        SELECT CASE WHEN vulnerable = 1 THEN 'Vulnerable' ELSE 'Not Vulnerable' END AS "group",
               count(label) AS cases, round_even(avg(label), 3) AS rate
        FROM cases WHERE vulnerable IS NOT NULL GROUP BY vulnerable"""),
    "d1_rate_by_segment": with_cases("""
        SELECT grp_b_simple, count(label) AS cases, round_even(avg(label), 3) AS rate
        FROM cases WHERE grp_b_simple IS NOT NULL GROUP BY grp_b_simple"""),
    "d1_quality_by_source": """
        SELECT d.source, count(l.quality) AS cases, round_even(avg(l.quality), 3) AS rate
        FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id
        WHERE d.source IS NOT NULL GROUP BY d.source""",
    "d2_rate_top5_long": with_cases(f"""
        , long AS (
            SELECT 'grp_a' AS feature, CAST(grp_a AS VARCHAR) AS category, label FROM cases
            UNION ALL SELECT 'age', CAST(age AS VARCHAR), label FROM cases
            UNION ALL SELECT 'region', CAST(region AS VARCHAR), label FROM cases
            UNION ALL SELECT 'grp_b', CAST(grp_b AS VARCHAR), label FROM cases),
        agg AS (SELECT feature, category, avg(label) AS rate, count(*) AS cases
                FROM long WHERE category IS NOT NULL GROUP BY feature, category),
        ranked AS (SELECT *, {_rank('rate DESC NULLS LAST, category', 'feature')} AS rank,
                          greatest(count(*) OVER (PARTITION BY feature) - 5, 0) AS other_categories
                   FROM agg)
        SELECT feature, category, round(rate, 6) AS rate, cases, rank, other_categories
        FROM ranked WHERE rank <= 5"""),
    "d3_mean_by_year": with_cases("""
        SELECT year, round(avg(label), 6) AS rate FROM cases
        WHERE year IS NOT NULL GROUP BY year"""),
    "d4_summary": with_cases("""
        SELECT count(*) AS n_rows, CAST(sum(label) AS BIGINT) AS n_solved,
               round(avg(label), 6) AS rate,
               count(*) FILTER (WHERE label = 0) AS n_open,
               CAST(count(*) - coalesce(sum(label), 0) AS BIGINT) AS n_open_all,
               count(label) AS n_labelled
        FROM cases"""),
    "d5_value_counts": with_cases("""
        SELECT region, count(*) AS n FROM cases WHERE region IS NOT NULL GROUP BY region"""),
    "d6_mode_by_region": with_cases("""
        , m AS (
          SELECT region, 'item' AS c, CAST(item AS VARCHAR) AS v, count(*) AS n
            FROM cases WHERE item IS NOT NULL GROUP BY region, item
          UNION ALL SELECT region, 'grp_a', CAST(grp_a AS VARCHAR), count(*)
            FROM cases WHERE grp_a IS NOT NULL GROUP BY region, grp_a
          UNION ALL SELECT region, 'age_cat', CAST(age_cat AS VARCHAR), count(*)
            FROM cases WHERE age_cat IS NOT NULL GROUP BY region, age_cat),
        best AS (SELECT region, c, v FROM (
            SELECT *, row_number() OVER (PARTITION BY region, c ORDER BY n DESC, v) AS rn FROM m)
            WHERE rn = 1),
        g AS (SELECT DISTINCT region FROM cases)
        SELECT g.region,
          coalesce(max(CASE WHEN c = 'item' THEN v END), 'N/A') AS mode_item,
          coalesce(max(CASE WHEN c = 'grp_a' THEN v END), 'N/A') AS mode_grp_a,
          coalesce(max(CASE WHEN c = 'age_cat' THEN v END), 'N/A') AS mode_age_cat
        FROM g LEFT JOIN best b ON g.region IS NOT DISTINCT FROM b.region
        GROUP BY g.region"""),
    "d7_price_stats": with_cases("""
        SELECT round(avg(price), 6) AS mean, round(quantile_cont(price, 0.5), 6) AS median,
               round(min(price), 6) AS min, round(max(price), 6) AS max FROM cases"""),
    "d8_yearly_rate_range": with_cases("""
        SELECT round(min(rate), 6) AS min_rate, round(max(rate), 6) AS max_rate FROM (
            SELECT year, avg(label) AS rate FROM cases WHERE year IS NOT NULL GROUP BY year)"""),
    "d9_missing_profile": with_cases("""
        , p AS (SELECT avg(CASE WHEN age IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS age,
                       avg(CASE WHEN item IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS item,
                       avg(CASE WHEN grp_a IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS grp_a,
                       avg(CASE WHEN year IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS year,
                       avg(CASE WHEN region IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS region,
                       avg(CASE WHEN outcome IS NULL THEN 1.0 ELSE 0.0 END) * 100 AS outcome
                FROM cases)
        SELECT "column", round(missing_pct, 6) AS missing_pct FROM (
            SELECT 'age' AS "column", age AS missing_pct FROM p
            UNION ALL SELECT 'item', item FROM p UNION ALL SELECT 'grp_a', grp_a FROM p
            UNION ALL SELECT 'year', year FROM p UNION ALL SELECT 'region', region FROM p
            UNION ALL SELECT 'outcome', outcome FROM p) WHERE missing_pct > 0"""),
    "d10_share_by_priority": with_cases("""
        SELECT grp_a, count(*) AS size,
               round(CAST(count(*) AS DOUBLE) * 100 / sum(count(*)) OVER (), 6) AS pct
        FROM cases WHERE label = 0 GROUP BY grp_a"""),
    "d11_shape": with_cases("SELECT count(*) AS n_rows, 14 AS n_cols FROM base_cases"),
    "f2_top5_regions": with_cases(f"""
        SELECT region, round(rate, 6) AS rate, cases, {_rank('rate DESC NULLS LAST, region')} AS rank
        FROM (SELECT region, avg(label) AS rate, count(label) AS cases FROM cases
              WHERE region IS NOT NULL GROUP BY region)
        ORDER BY rate DESC NULLS LAST, region LIMIT 5"""),
    "f3_bottom5_regions": with_cases(f"""
        SELECT region, round(rate, 6) AS rate, cases, {_rank('rate DESC NULLS LAST, region')} AS rank
        FROM (SELECT region, avg(label) AS rate, count(label) AS cases FROM cases
              WHERE region IS NOT NULL GROUP BY region
              ORDER BY rate ASC NULLS FIRST, region DESC LIMIT 5)"""),
    "f4_best_worst_years": with_cases(f"""
        , y AS (SELECT year, avg(label) AS rate FROM cases WHERE year IS NOT NULL GROUP BY year)
        SELECT 'top' AS side, year, round(rate, 6) AS rate, {_rank('rate DESC NULLS LAST, year')} AS rank
          FROM (SELECT * FROM y ORDER BY rate DESC NULLS LAST, year LIMIT 3)
        UNION ALL
        SELECT 'bottom', year, round(rate, 6), {_rank('rate ASC NULLS LAST, year')}
          FROM (SELECT * FROM y ORDER BY rate ASC NULLS LAST, year LIMIT 3)"""),
    "f5_top_open_by_price": with_cases(f"""
        SELECT record_id, price, {_rank('price DESC NULLS LAST, record_id')} AS rank
        FROM (SELECT * FROM cases WHERE label = 0
              ORDER BY price DESC NULLS LAST, record_id LIMIT 5)"""),
    "f6_both_ends_items": with_cases(f"""
        , t AS (SELECT item, avg(label) AS rate FROM cases WHERE item IS NOT NULL GROUP BY item)
        SELECT 'top' AS side, item, round(rate, 6) AS rate, {_rank('rate DESC NULLS LAST, item')} AS rank
          FROM (SELECT * FROM t ORDER BY rate DESC NULLS LAST, item LIMIT 5)
        UNION ALL
        SELECT 'bottom', item, round(rate, 6), {_rank('rate ASC NULLS LAST, item')}
          FROM (SELECT * FROM t ORDER BY rate ASC NULLS LAST, item LIMIT 5)"""),
}


def _topk_sql(src: str, cols, k: int = 15) -> str:
    parts = " UNION ALL ".join(
        f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS value, count(*) AS n FROM {src} "
        f"WHERE {c} IS NOT NULL GROUP BY {c}" for c in cols)
    return (f"SELECT col, value FROM (SELECT col, value, row_number() OVER "
            f"(PARTITION BY col ORDER BY n DESC, value) AS rn FROM ({parts})) WHERE rn <= {k}")


def _bucket_sql(c: str) -> str:
    return (f"CASE WHEN CAST({c} AS VARCHAR) IN (SELECT value FROM topk WHERE col = '{c}') "
            f"THEN CAST({c} AS VARCHAR) ELSE 'Other' END")


def _hash(key: str = "record_id", seed: int = 42) -> str:
    return f"md5(CAST({key} AS VARCHAR) || '|{seed}')"


_SPLIT = f"""
    split AS (
      SELECT *, CASE WHEN rn <= ceil(cnt * 3 / 10) THEN 'test' ELSE 'train' END AS split
      FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {_hash()}, record_id) AS rn,
                   count(*) OVER (PARTITION BY label) AS cnt
            FROM cases WHERE label IS NOT NULL))"""

_MODEL_CAT = ["grp_a", "age_category", "item_group", "region"]
_MODEL_NUM = ["age", "units", "year"]

_LAB_BUCKETED = f"""
    lab AS (SELECT * FROM cases WHERE label IS NOT NULL),
    topk AS ({_topk_sql('lab', _MODEL_CAT)}),
    bl AS (SELECT record_id, label, age, units, year,
                  {', '.join(_bucket_sql(c) + ' AS ' + c for c in _MODEL_CAT)} FROM lab),
    cats AS ({' UNION ALL '.join(f"SELECT DISTINCT '{c}' AS col, {c} AS category, {i} AS ci FROM bl WHERE {c} IS NOT NULL" for i, c in enumerate(_MODEL_CAT))}),
    kept AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY category) AS rn
                            FROM cats) WHERE rn > 1),
    vocab AS (
      SELECT CAST(pos AS INTEGER) AS pos, feature, "column", category FROM (
        SELECT {len(_MODEL_NUM)} - 1 + row_number() OVER (ORDER BY ci, category) AS pos,
               col || '_' || category AS feature, col AS "column", category FROM kept
        UNION ALL SELECT 0, 'age', 'age', NULL UNION ALL SELECT 1, 'units', 'units', NULL
        UNION ALL SELECT 2, 'year', 'year', NULL))"""

ORACLES.update({
    "b13_impute_mode": with_cases("""
        , m AS (SELECT item_group AS v FROM cases WHERE item_group IS NOT NULL
                GROUP BY item_group ORDER BY count(*) DESC, item_group LIMIT 1)
        SELECT record_id, CASE WHEN item_group = 'Unknown' THEN (SELECT v FROM m)
                               ELSE item_group END AS item_group FROM cases"""),
    "b14_minmax_year": with_cases("""
        SELECT record_id, round(CAST(year - (SELECT min(year) FROM cases) AS DOUBLE)
               / nullif((SELECT max(year) - min(year) FROM cases), 0), 6) AS year_norm
        FROM cases"""),
    "b15_topk_bucket": with_cases(f"""
        , topk AS ({_topk_sql('cases', ['region', 'item'])})
        SELECT record_id, {_bucket_sql('region')} AS region, {_bucket_sql('item')} AS item
        FROM cases"""),
    "c3_semi_join_topk": with_cases(f"""
        , topk AS ({_topk_sql('cases', ['region'])})
        SELECT region, count(*) AS n FROM cases
        WHERE region IN (SELECT value FROM topk) GROUP BY region"""),
    "c1_target_encode": with_cases("""
        , r AS (SELECT region AS k, avg(label) AS rate FROM cases
                WHERE region IS NOT NULL GROUP BY region HAVING avg(label) IS NOT NULL)
        SELECT record_id, region,
               round(coalesce(r.rate, (SELECT avg(label) FROM cases)), 6) AS region_rate
        FROM cases LEFT JOIN r ON cases.region = r.k"""),
    "b18_rate_fallback": with_cases(f""",{_SPLIT},
        train AS (SELECT * FROM split WHERE split = 'train'),
        r AS (SELECT item AS k, avg(label) AS rate FROM train
              WHERE item IS NOT NULL GROUP BY item HAVING avg(label) IS NOT NULL)
        SELECT record_id, item,
               round(coalesce(r.rate, (SELECT avg(label) FROM train)), 6) AS item_rate
        FROM cases LEFT JOIN r ON cases.item = r.k"""),
    "b25_exact_sample": with_cases(f"""
        SELECT record_id, label FROM (
          SELECT record_id, label, row_number() OVER (ORDER BY {_hash()}, record_id) AS rn,
                 count(*) OVER () AS cnt FROM cases)
        WHERE rn <= round_even(cnt * 0.3, 0)"""),
    "i4_stratified_split": with_cases(f",{_SPLIT} SELECT record_id, label, split FROM split"),
    "i5_stratified_folds": with_cases(f"""
        SELECT record_id, label,
               CAST((row_number() OVER (PARTITION BY label ORDER BY {_hash()}, record_id) - 1) % 5
                    AS INTEGER) AS fold
        FROM cases WHERE label IS NOT NULL"""),
    "i6_class_weights": with_cases("""
        SELECT label, count(*) AS n,
               round(CAST(sum(count(*)) OVER () AS DOUBLE) / (count(*) OVER () * count(*)), 6) AS weight
        FROM cases WHERE label IS NOT NULL GROUP BY label"""),
    "a8_vocab": with_cases(f",{_LAB_BUCKETED} SELECT * FROM vocab"),
    "i2_onehot_drop_first": with_cases(f""",{_LAB_BUCKETED}
        SELECT k.col || '_' || k.category AS feature, count(*) AS n_ones
        FROM kept k JOIN ({' UNION ALL '.join(f"SELECT '{c}' AS col, {c} AS category FROM bl" for c in _MODEL_CAT)}) x
          ON k.col = x.col AND k.category = x.category
        GROUP BY k.col, k.category"""),
    "i1_onehot_keep_all": with_cases("""
        , o AS (SELECT * FROM cases WHERE label = 0),
        x AS (""" + " UNION ALL ".join(
            f"SELECT '{c}' AS col, CAST({c} AS VARCHAR) AS category FROM o WHERE {c} IS NOT NULL"
            for c in ["item_group", "grp_b_simple", "grp_a", "age_cat", "region"]) + """)
        SELECT col || '_' || category AS feature, count(*) AS n_ones FROM x GROUP BY col, category"""),
    "i3_label_codes": with_cases("""
        , o AS (SELECT * FROM cases WHERE label = 0)
        SELECT record_id, """ + ", ".join(
            f"CAST(dense_rank() OVER (ORDER BY coalesce(CAST({c} AS VARCHAR), 'nan')) - 1 AS INTEGER) AS {c}_code"
            for c in ["grp_a", "age_cat", "item_group", "grp_b_simple", "region"]) + " FROM o"),
})

_ASSOC = ["item_group", "grp_b_simple", "grp_a", "age_cat", "region"]


def _itemsets_sql(src: str = "SELECT * FROM cases WHERE label = 0", cols=None,
                  min_support: float = 0.01) -> str:
    from itertools import combinations
    cols = cols or _ASSOC
    sets = ", ".join("(" + ", ".join(s) + ")" for j in (1, 2, 3) for s in combinations(cols, j))
    items = ", ".join(
        f"CASE WHEN grouping({c}) = 0 THEN '{c}_' || CAST({c} AS VARCHAR) END" for c in cols)
    nulls = " AND ".join(f"NOT (grouping({c}) = 0 AND {c} IS NULL)" for c in cols)
    return f"""
    , o AS ({src}),
    tot AS (SELECT count(*) AS total FROM o),
    iset AS (
      SELECT list_sort(list_distinct([{items}])) AS items, count(*) AS n
      FROM o GROUP BY GROUPING SETS ({sets})
      HAVING {nulls} AND count(*) >= {min_support} * (SELECT total FROM tot)),
    its AS (SELECT items, array_to_string(items, ', ') AS items_text,
                   CAST(len(items) AS INTEGER) AS size, n,
                   n / (SELECT CAST(total AS DOUBLE) FROM tot) AS support FROM iset)"""


def _rules_sql(src: str = "SELECT * FROM cases WHERE label = 0", cols=None) -> str:
    splits = []
    for a, c in (([1], [2]), ([2], [1])):
        splits.append((a, c, 2))
    for a, c in (([1], [2, 3]), ([2], [1, 3]), ([3], [1, 2]),
                 ([2, 3], [1]), ([1, 3], [2]), ([1, 2], [3])):
        splits.append((a, c, 3))
    parts = []
    for a, c, k in splits:
        at = " || ', ' || ".join(f"items[{i}]" for i in a)
        ct = " || ', ' || ".join(f"items[{i}]" for i in c)
        parts.append(f"SELECT {at} AS ant, {ct} AS con, support FROM its WHERE size = {k}")
    return _itemsets_sql(src, cols) + f""",
    sp AS ({' UNION ALL '.join(parts)}),
    rl AS (
      SELECT sp.ant AS antecedents, sp.con AS consequents,
             a.support AS antecedent_support, c.support AS consequent_support,
             sp.support, sp.support / a.support AS confidence,
             sp.support / a.support / c.support AS lift,
             sp.support - a.support * c.support AS leverage,
             CASE WHEN sp.support / a.support < 1
                  THEN (1 - c.support) / (1 - sp.support / a.support) END AS conviction
      FROM sp JOIN its a ON sp.ant = a.items_text JOIN its c ON sp.con = c.items_text
      WHERE sp.support / a.support / c.support >= 1.2)"""


_RULES_OUT = """
        SELECT antecedents, consequents, round(antecedent_support, 6) AS antecedent_support,
               round(consequent_support, 6) AS consequent_support, round(support, 6) AS support,
               round(confidence, 6) AS confidence, round(lift, 6) AS lift,
               round(leverage, 6) AS leverage, round(conviction, 6) AS conviction FROM rl"""

_DOCS = "SELECT d.doc_id, d.lang, d.source, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id"
_DOC_COLS = ["lang", "source", "toxic"]

ORACLES.update({
    "d12_itemsets": with_cases(_itemsets_sql() + """
        SELECT items_text, size, n, round(support, 6) AS support FROM its"""),
    "d13_rules": with_cases(_rules_sql() + _RULES_OUT),
    "d13_top10_rules": with_cases(_rules_sql() + """
        , t AS (SELECT * FROM rl ORDER BY lift DESC, antecedents, consequents LIMIT 10)
        SELECT CAST(row_number() OVER (ORDER BY lift DESC, antecedents, consequents) AS INTEGER) AS rank,
               array_to_string(string_split(antecedents, ', ')[1:2], ', ') AS antecedents_head,
               array_to_string(string_split(consequents, ', ')[1:2], ', ') AS consequents_head,
               round(lift, 6) AS lift, round(support, 6) AS support FROM t"""),
})

_SCORED = _SPLIT + """,
    scored AS (SELECT *, price / (SELECT max(price) FROM cases) AS score FROM split),
    ev AS (SELECT * FROM scored WHERE split = 'test')"""

_CONF = """
    conf AS (SELECT count(*) FILTER (WHERE label = 0 AND score < 0.5) AS tn,
                    count(*) FILTER (WHERE label = 0 AND score >= 0.5) AS fp,
                    count(*) FILTER (WHERE label = 1 AND score < 0.5) AS fn,
                    count(*) FILTER (WHERE label = 1 AND score >= 0.5) AS tp FROM ev)"""


def _auc_sql(src: str, group: str | None = None) -> str:
    g = f"{group}, " if group else ""
    pb = f"PARTITION BY {group} " if group else ""
    return f"""
      SELECT {g}sum(pos * (coalesce(neg_below, 0) + neg / 2.0)) / (sum(pos) * sum(neg)) AS auc
      FROM (SELECT *, sum(neg) OVER ({pb}ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING
                                     AND 1 PRECEDING) AS neg_below
            FROM (SELECT {g}score, sum(label) AS pos, sum(1 - label) AS neg FROM {src}
                  GROUP BY {g}score))
      {'GROUP BY ' + group if group else ''}"""


ORACLES.update({
    "d14_confusion": with_cases(f",{_SCORED},{_CONF} SELECT * FROM conf"),
    "d15_metrics": with_cases(f""",{_SCORED},{_CONF},
        pr AS (SELECT *, CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) AS accuracy,
                      CASE WHEN tp + fp > 0 THEN CAST(tp AS DOUBLE) / (tp + fp) ELSE 0.0 END AS precision,
                      CASE WHEN tp + fn > 0 THEN CAST(tp AS DOUBLE) / (tp + fn) ELSE 0.0 END AS recall
               FROM conf)
        SELECT round(accuracy, 6) AS accuracy, round(precision, 6) AS precision,
               round(recall, 6) AS recall,
               round(CASE WHEN precision + recall > 0
                          THEN 2 * precision * recall / (precision + recall) ELSE 0.0 END, 6) AS f1
        FROM pr"""),
    "d16_class_report": with_cases(f""",{_SCORED},{_CONF},
        c AS (SELECT '0' AS class, tn AS t, fn AS fpos, fp AS fneg, tn + fp AS support FROM conf
              UNION ALL SELECT '1', tp, fp, fn, tp + fn FROM conf),
        m AS (SELECT class, CASE WHEN t + fpos > 0 THEN CAST(t AS DOUBLE) / (t + fpos) ELSE 0.0 END AS p,
                     CASE WHEN t + fneg > 0 THEN CAST(t AS DOUBLE) / (t + fneg) ELSE 0.0 END AS r,
                     support FROM c),
        f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END AS f1 FROM m),
        tot AS (SELECT sum(support) AS n FROM f)
        SELECT class, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1,
               CAST(support AS BIGINT) AS support FROM f
        UNION ALL SELECT 'accuracy', NULL, NULL,
               round((SELECT CAST(tp + tn AS DOUBLE) / (tp + tn + fp + fn) FROM conf), 6),
               CAST((SELECT n FROM tot) AS BIGINT)
        UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f1), 6),
               CAST(sum(support) AS BIGINT) FROM f
        UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6),
               round(sum(r * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6),
               CAST(sum(support) AS BIGINT) FROM f"""),
    "d17_threshold_table": with_cases(f""",{_SCORED},
        t AS (SELECT * FROM (VALUES (0.8, 'High Priority'), (0.7, 'Medium Priority'),
                                    (0.6, 'Low Priority')) v(threshold, level)),
        a AS (SELECT CAST(t.threshold AS DOUBLE) AS threshold, t.level,
                     count(*) FILTER (WHERE ev.score >= t.threshold) AS n_at,
                     count(*) FILTER (WHERE ev.score >= t.threshold AND ev.label = 1) AS tp,
                     count(*) AS total, sum(ev.label) AS positives
              FROM t, ev GROUP BY t.threshold, t.level)
        SELECT threshold, level, n_at, round(n_at * 100.0 / total, 6) AS pct, tp,
               round(CASE WHEN n_at > 0 THEN CAST(tp AS DOUBLE) / n_at ELSE 0.0 END, 6) AS precision_at,
               round(tp * 100.0 / positives, 6) AS recall_at_pct FROM a"""),
    "d18_score_histogram": with_cases(f""",{_SCORED},
        st AS (SELECT label, min(score) AS lo, max(score) AS hi, count(*) AS n_class FROM ev
               GROUP BY label),
        b AS (SELECT ev.label, CAST(CASE WHEN hi > lo THEN least(floor((score - lo) * 50 / (hi - lo)), 49)
                                         ELSE 0 END AS INTEGER) AS bin
              FROM ev JOIN st ON ev.label = st.label),
        cnt AS (SELECT label, bin, count(*) AS n FROM b GROUP BY label, bin),
        grid AS (SELECT st.*, CAST(g.bin AS INTEGER) AS bin FROM st, range(50) g(bin))
        SELECT grid.label, grid.bin, round(lo + grid.bin * ((hi - lo) / 50), 6) AS bin_start,
               coalesce(cnt.n, 0) AS n,
               round(CASE WHEN hi > lo THEN coalesce(cnt.n, 0) / (n_class * ((hi - lo) / 50)) END, 6) AS density
        FROM grid LEFT JOIN cnt ON grid.label = cnt.label AND grid.bin = cnt.bin"""),
    "d19_auc": with_cases(f",{_SCORED} SELECT round(auc, 6) AS auc FROM ({_auc_sql('ev')})"),
    "d20_overfit_gap": with_cases(f""",{_SCORED},
        a AS ({_auc_sql('scored', 'split')})
        SELECT round((SELECT auc FROM a WHERE split = 'train'), 6) AS train_auc,
               round((SELECT auc FROM a WHERE split = 'test'), 6) AS test_auc,
               round((SELECT auc FROM a WHERE split = 'train') - (SELECT auc FROM a WHERE split = 'test'), 6) AS gap"""),
    "e2_roc": with_cases(f""",{_SCORED},
        g AS (SELECT score, sum(label) AS pos, sum(1 - label) AS neg FROM ev GROUP BY score),
        c AS (SELECT score, sum(pos) OVER (ORDER BY score DESC) AS tps,
                     sum(neg) OVER (ORDER BY score DESC) AS fps,
                     row_number() OVER (ORDER BY score DESC) AS j, count(*) OVER () AS m FROM g),
        k AS (SELECT *, lag(tps) OVER (ORDER BY j) AS tp_prev, lead(tps) OVER (ORDER BY j) AS tp_next,
                        lag(fps) OVER (ORDER BY j) AS fp_prev, lead(fps) OVER (ORDER BY j) AS fp_next
              FROM c),
        pts AS (SELECT score AS threshold, tps, fps FROM k
                WHERE j = 1 OR j = m OR fp_prev - 2 * fps + fp_next <> 0
                      OR tp_prev - 2 * tps + tp_next <> 0
                UNION ALL SELECT 'inf'::DOUBLE, 0, 0),
        tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM g)
        SELECT round(fps / (SELECT CAST(N AS DOUBLE) FROM tot), 6) AS fpr,
               round(tps / (SELECT CAST(P AS DOUBLE) FROM tot), 6) AS tpr, threshold FROM pts"""),
    "d7_score_stats_open": with_cases(f""",{_SCORED}
        SELECT round(avg(score), 6) AS mean, round(quantile_cont(score, 0.5), 6) AS median,
               round(min(score), 6) AS min, round(max(score), 6) AS max
        FROM scored WHERE label = 0"""),
})

_CL = ["sex", "age_cat", "weapon_group", "relation_simple", "region"]
_CL_SEED = f"""
    , o AS (SELECT record_id, {', '.join(f"coalesce(CAST({c} AS VARCHAR), 'nan') AS {c}" for c in _CL)}
            FROM cases WHERE label = 0),
    t AS (SELECT {', '.join(_CL)}, count(*) AS w FROM o GROUP BY {', '.join(_CL)}),
    m AS (SELECT *, CAST(row_number() OVER (ORDER BY w DESC, {', '.join(_CL)}) - 1 AS INTEGER) AS cluster
          FROM (SELECT * FROM t ORDER BY w DESC, {', '.join(_CL)} LIMIT 5)),
    d AS (SELECT o.record_id, m.cluster,
                 CAST({' + '.join(f"CAST(o.{c} <> m.{c} AS INTEGER)" for c in _CL)} AS INTEGER) AS distance
          FROM o, m),
    asg AS (SELECT record_id, cluster, distance FROM (
              SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY distance, cluster) AS rn
              FROM d) WHERE rn = 1),
    ao AS (SELECT o.*, asg.cluster FROM o JOIN asg USING (record_id))"""


def _profile_sql() -> str:
    modes = " UNION ALL ".join(
        f"SELECT cluster, '{c}' AS col, {c} AS v, count(*) AS n FROM ao GROUP BY cluster, {c}"
        for c in _CL)
    pick = ", ".join(
        f"coalesce(max(CASE WHEN col = '{c}' THEN v END), 'N/A') AS mode_{c}" for c in _CL)
    return f""",
    mc AS (SELECT cluster, col, v FROM (
             SELECT *, row_number() OVER (PARTITION BY cluster, col ORDER BY n DESC, v) AS rn
             FROM ({modes})) WHERE rn = 1),
    mm AS (SELECT cluster, {pick} FROM mc GROUP BY cluster),
    sz AS (SELECT cluster, count(*) AS size FROM ao GROUP BY cluster),
    ks AS (SELECT CAST(range AS INTEGER) AS cluster FROM range(5)),
    prof AS (
      SELECT ks.cluster, coalesce(sz.size, 0) AS size,
             round(coalesce(sz.size, 0) * 100.0 / (SELECT count(*) FROM ao), 6) AS pct,
             {', '.join(f"coalesce(mm.mode_{c}, 'N/A') AS mode_{c}" for c in _CL)}
      FROM ks LEFT JOIN sz ON ks.cluster = sz.cluster LEFT JOIN mm ON ks.cluster = mm.cluster)"""


ORACLES.update({
    "i10_kmodes_assign": with_cases(_CL_SEED + " SELECT * FROM asg"),
    "i12_cluster_profiles": with_cases(_CL_SEED + _profile_sql() + """
        SELECT *, concat_ws('; ',
            CASE WHEN mode_relation_simple IN ('Stranger', 'Other', 'Unknown')
                 THEN 'High anonymity, low relational density → difficult to solve' END,
            CASE WHEN NOT mode_relation_simple IN ('Stranger', 'Other', 'Unknown')
                 THEN 'Known offender – potential for witness leads' END,
            CASE WHEN mode_weapon_group = 'Firearm' THEN 'Firearm used – ballistic evidence may exist' END,
            CASE WHEN mode_weapon_group = 'Unknown' THEN 'Missing weapon information – critical evidence gap' END,
            CASE WHEN mode_sex = 'Female' AND mode_age_cat IN ('Child', 'Senior')
                 THEN 'Vulnerable victim – social network may have information' END,
            'Common state: ' || mode_region || ' – consider jurisdictional practices') AS notes
        FROM prof"""),
    "i10_kmodes_step": with_cases(_CL_SEED + _profile_sql() + f"""
        SELECT cluster, size, {', '.join('mode_' + c for c in _CL)} FROM prof WHERE size > 0"""),
    "i10_kmodes_fit_converged": with_cases("""
        SELECT 5 AS n_modes, 0 AS n_moved, count(*) AS n_rows FROM cases WHERE label = 0"""),
    "d10_cluster_share": with_cases(_CL_SEED + _profile_sql() + """
        SELECT cluster, size, pct FROM prof"""),
})

_STANDIN = """
    , sd AS (SELECT *, price / (SELECT max(price) FROM cases) AS p FROM cases)"""

# A request's number fields by their form (code): absent, null, "", " ", "0", 0, 2.5, "2.5", "abc", number, text.
_REQ = """
    , codes AS (SELECT *, CAST(record_id AS VARCHAR) AS request_id, record_id % 11 AS ca, record_id // 11 % 11 AS cv,
                  record_id // 3 % 11 AS cy, record_id // 5 % 11 AS cr, record_id % 4 AS cs, record_id // 2 % 4 AS ct,
                  record_id // 4 % 4 AS cw, round(0.54 + (record_id % 30) / 100.0, 2) AS given_rate FROM cases),
    rq AS (SELECT request_id, record_id,
      CASE WHEN ca = 4 THEN 0.0 WHEN ca IN (6, 7) THEN 2.5 WHEN ca IN (9, 10) THEN coalesce(trunc(age), 25.0) ELSE 25.0 END AS v_age,
      CAST(CASE WHEN cv = 4 THEN 0 WHEN cv = 6 THEN 2 WHEN cv IN (9, 10) THEN CASE WHEN units = 0 AND cv = 9 THEN 1 ELSE units END
           ELSE 1 END AS INTEGER) AS v_victims,
      CAST(CASE WHEN cy = 4 THEN 0 WHEN cy = 6 THEN 2 WHEN cy IN (9, 10) THEN coalesce(year, 2023) ELSE 2023 END AS INTEGER) AS v_year,
      CASE WHEN cr IN (4, 5) THEN 0.0 WHEN cr IN (6, 7) THEN 2.5 WHEN cr IN (9, 10) THEN given_rate ELSE 0.6 END AS v_rate,
      CASE WHEN cs = 0 THEN 'Unknown' WHEN cs = 1 THEN NULL ELSE coalesce(sex, 'Unknown') END AS v_sex,
      'Unknown' AS v_race,
      CASE WHEN cw = 0 THEN 'Other' WHEN cw = 1 THEN NULL ELSE coalesce(weapon, 'Other') END AS v_weapon,
      CASE WHEN ct = 0 THEN 'Unknown' WHEN ct = 1 THEN NULL ELSE coalesce(region, 'Unknown') END AS v_state,
      CASE WHEN ct IN (2, 3) THEN region END AS state_text,
      CASE WHEN ca IN (3, 8) OR cv IN (3, 7, 8) OR cy IN (3, 7, 8) OR cr IN (2, 3, 8)
           THEN 'Données numériques invalides' END AS error
      FROM codes)"""

# What the model sees: the rates and the mean age of the training rows.
_TRAIN = _SPLIT + """,
    tr AS (SELECT * FROM split WHERE split = 'train'),
    rates AS (SELECT region AS r_region, avg(label) AS r_rate FROM tr WHERE region IS NOT NULL GROUP BY region),
    means AS (SELECT avg(label) AS g_rate, avg(age) AS g_age FROM tr)"""


def _score_sql(age: str, units: str, rate: str, sex: str, age_category: str, weapon: str) -> str:
    return (f"1 / (1 + exp(-(-1.5 + 0.01 * coalesce({age}, (SELECT g_age FROM means)) + 0.05 * {units} + 2.0 * {rate} "
            f"+ CASE {sex} WHEN 'Male' THEN 0.4 WHEN 'Unknown' THEN -0.3 ELSE 0 END "
            f"+ CASE {age_category} WHEN 'Child' THEN 0.6 WHEN 'Senior' THEN -0.4 ELSE 0 END "
            f"+ CASE {weapon} WHEN 'Firearm' THEN 0.8 WHEN 'Knife' THEN -0.5 WHEN 'Other' THEN 0.2 "
            f"WHEN 'Strangulation' THEN -0.9 ELSE 0 END)))")


_FIXED = _TRAIN + f""",
    fx AS (SELECT c.*, {_score_sql('age', 'units', 'coalesce(r_rate, (SELECT g_rate FROM means))', 'sex', 'age_category', 'weapon_service')} AS p
           FROM cases c LEFT JOIN rates ON c.region = r_region),
    fs AS (SELECT fx.*, split.split, split.rn, round(fx.p, 6) AS score FROM fx JOIN split ON fx.record_id = split.record_id),
    ev AS (SELECT * FROM fs WHERE split = 'test')"""

_TIERS = """CASE WHEN p >= 0.8 THEN 'HIGH PRIORITY' WHEN p >= 0.7 THEN 'MEDIUM-HIGH PRIORITY'
                 WHEN p >= 0.6 THEN 'MEDIUM PRIORITY' WHEN p >= 0.5 THEN 'LOW-MEDIUM PRIORITY' ELSE 'LOW PRIORITY' END"""
_ADVISED = """CASE WHEN p >= 0.8 THEN 'Assign experienced investigators immediately' WHEN p >= 0.7 THEN 'Assign dedicated investigator'
                   WHEN p >= 0.6 THEN 'Standard investigation' WHEN p >= 0.5 THEN 'Basic investigation'
                   ELSE 'Minimal resources, revisit if new evidence emerges' END"""
_LIKELY = "CASE WHEN p >= 0.5 THEN 'Likely Solvable' ELSE 'Likely Unsolvable' END"
_PROFILE = "CASE WHEN p > 0.75 THEN 'Cas Prioritaire' WHEN p > 0.4 THEN 'Cas Standard' ELSE 'Cold Case Potentiel' END"
_FLAG = "(coalesce({0} < 18 OR {0} > 65, FALSE))"
_LABEL = "CASE WHEN {0} THEN 'Vulnérable' ELSE 'Adulte Standard' END"


def _analysis_sql(p: str, vuln: str, state: str, firearm: str) -> str:
    return (f"'Probabilité de résolution : ' || printf('%.1f%%', {p} * 100) || '. Profil victime (' || {_LABEL.format(vuln)} "
            f"|| ') en ' || coalesce({state}, 'None') || ' suggère priorité ' "
            f"|| CASE WHEN {vuln} OR {p} > 0.7 THEN 'ÉLEVÉE' ELSE 'NORMALE' END || '. ' "
            f"|| CASE WHEN {firearm} THEN 'Analyse balistique recommandée.' ELSE '' END")


def _responses_sql() -> str:
    good = lambda x: f"CASE WHEN error IS NULL THEN {x} END"
    weapon = _weapon_sql("Other", "Blunt Object").replace("weapon", "v_weapon")
    vuln = _FLAG.format("v_age")
    fields = {
        "probability": "round(p, 6)", "percent": "printf('%.1f%%', p * 100)",
        "verdict": "CASE WHEN p >= 0.55 THEN 'Resolved' ELSE 'Unresolved' END", "vulnerability": "vuln",
        "vulnerability_label": _LABEL.format("vuln"),
        "factor0_label": "'Fiabilité Modèle'", "factor0_value": "'Random Forest Optimisé (AUC ~0.82)'", "factor0_impact": "'positive'",
        "factor1_label": "'Facteur Arme'", "factor1_value": "'Impact ' || wg",
        "factor1_impact": "CASE WHEN wg = 'Other' THEN 'neutral' ELSE 'positive' END",
        "factor2_label": "'Démographie'", "factor2_value": f"'Victime ' || ag || ' (' || {_LABEL.format('vuln')} || ')'",
        "factor2_impact": "CASE WHEN vuln THEN 'positive' ELSE 'neutral' END",
        "factor3_label": "'Localisation'", "factor3_value": "'Zone ' || coalesce(state_text, 'None')",
        "factor3_impact": "CASE WHEN v_rate > 0.65 THEN 'positive' ELSE 'negative' END",
        "vulnerability_score": "CASE WHEN vuln THEN 'ÉLEVÉ' ELSE 'MODÉRÉ' END", "risk_profile": _PROFILE,
        "investigation_advice": "CASE WHEN wg = 'Firearm' THEN 'Focus sur preuves balistiques' ELSE 'Recherche de témoins' END",
        "analysis": _analysis_sql("p", "vuln", "state_text", "wg = 'Firearm'")}
    return f"""{_REQ},{_TRAIN.strip().removeprefix(',')},
    dv AS (SELECT *, {weapon} AS wg, {vuln} AS vuln,
             CASE WHEN v_age < 18 THEN 'Child' WHEN v_age < 30 THEN 'Young Adult' WHEN v_age < 50 THEN 'Adult'
                  WHEN v_age < 65 THEN 'Middle Aged' ELSE 'Senior' END AS ag FROM rq),
    sc AS (SELECT *, {_score_sql('v_age', 'v_victims', 'v_rate', 'v_sex', 'ag', 'wg')} AS p FROM dv)
    SELECT request_id, error, {', '.join(f"{good(x)} AS {n}" for n, x in fields.items())} FROM sc"""


ORACLES.update({
    "b16_b17_request_coercion": with_cases(_REQ + """
        SELECT request_id, v_age, v_victims, v_year, round(v_rate, 6) AS v_rate, v_sex, v_race, v_weapon, v_state,
               state_text, error FROM rq"""),
    "b20_score_tiers": with_cases(_STANDIN + f"""
        SELECT record_id, {_TIERS} AS priority_level, {_ADVISED} AS investigation_recommendation,
               {_LIKELY} AS predicted_outcome, CAST(p >= 0.5 AS INTEGER) AS predicted_class FROM sd"""),
    "b21_decision_labels": with_cases(_STANDIN + f"""
        SELECT record_id, CASE WHEN p >= 0.55 THEN 'Resolved' ELSE 'Unresolved' END AS verdict,
               {_FLAG.format('age')} AS vulnerability, {_LABEL.format(_FLAG.format('age'))} AS vulnerability_label,
               {_PROFILE} AS risk_profile,
               CASE WHEN weapon_service = 'Firearm' THEN 'Focus sur preuves balistiques' ELSE 'Recherche de témoins' END AS advice,
               CASE WHEN p > 0.65 THEN 'positive' ELSE 'negative' END AS locality_impact,
               CASE WHEN weapon_service = 'Other' THEN 'neutral' ELSE 'positive' END AS weapon_impact,
               'Impact ' || weapon_service AS weapon_value,
               'Victime ' || age_category || ' (' || {_LABEL.format(_FLAG.format('age'))} || ')' AS demography_value,
               {_analysis_sql('p', _FLAG.format('age'), 'region', "weapon_service = 'Firearm'")} AS analysis
        FROM sd"""),
    "b22_display_bands": with_cases(_STANDIN + """
        SELECT record_id, CASE WHEN p >= 0.8 THEN '80-100%' WHEN p >= 0.6 THEN '60-80%' WHEN p >= 0.4 THEN '40-60%'
               WHEN p >= 0.2 THEN '20-40%' ELSE '0-20%' END AS band FROM sd"""),
    "a13_feature_catalogue": with_cases(f",{_LAB_BUCKETED}" + """
        SELECT count(*) AS features_count, string_agg(feature, ', ' ORDER BY pos) AS features,
               'ready' AS model_status FROM vocab"""),
})

ORACLES.update({
    "a1_csv_load": with_cases("""
        SELECT record_id AS "Record_ID", outcome AS "Crime_Solved", item AS "Item",
               CASE WHEN record_id % 9 <> 0 THEN age END AS "Victim_Age", grp_a AS "Group_A", grp_b AS "Group_B",
               region AS "State", units AS "Victim_Count", year AS "Year", month AS "Month", price AS "Price",
               CASE WHEN record_id % 8 IN (0, 1) THEN NULL WHEN record_id % 8 = 2 THEN 'a "gun", loaded' ELSE weapon END AS "Weapon",
               relation AS "Relationship", sex AS "Victim_Sex", label AS "Solved"
        FROM cases"""),
    "a5_rules_csv": with_cases(_rules_sql() + _RULES_OUT.replace(
        " FROM rl", ", row_number() OVER (ORDER BY round(lift, 9) DESC, antecedents, consequents) AS place FROM rl")),
    "f1_sorted_rates": with_cases("""
        SELECT *, row_number() OVER (ORDER BY rate DESC, region) AS place FROM (
          SELECT region, count(label) AS cases, round_even(avg(label), 3) AS rate
          FROM cases WHERE region IS NOT NULL GROUP BY region)"""),
    "a6_cluster_csv": with_cases(_CL_SEED + " SELECT record_id, cluster FROM asg"),
    "a7_ranked_open_csv": with_cases(f""",{_FIXED}
        SELECT record_id, outcome, item, age, grp_a, grp_b, region, units, year, month, price, weapon, relation, sex,
               round(round(p, 9), 6) AS score, row_number() OVER (ORDER BY round(p, 9) DESC, record_id) AS place
        FROM fx WHERE label = 0"""),
    "g1_vocab_drift": with_cases(f""",{_LAB_BUCKETED},
        tk AS ({_topk_sql('lab', _MODEL_CAT)}),
        batch AS (SELECT {', '.join(f"CASE WHEN CAST({c} AS VARCHAR) IN (SELECT value FROM tk WHERE col = '{c}') THEN CAST({c} AS VARCHAR) ELSE 'Other' END AS {c}" for c in _MODEL_CAT)}
                  FROM cases WHERE grp_a = '1-URGENT'),
        present AS (SELECT DISTINCT feature FROM (
            {' UNION ALL '.join(f"SELECT '{c}_' || {c} AS feature FROM batch WHERE {c} IS NOT NULL" for c in _MODEL_CAT)}
            UNION ALL SELECT 'age' UNION ALL SELECT 'units' UNION ALL SELECT 'year'))
        SELECT feature FROM vocab EXCEPT ALL SELECT feature FROM present"""),
})

ORACLES.update({
    "d2_documents_rates": f"""
        WITH docs AS ({_DOCS}),
        long AS (SELECT 'lang' AS feature, CAST(lang AS VARCHAR) AS category, quality FROM docs
                 UNION ALL SELECT 'source', CAST(source AS VARCHAR), quality FROM docs),
        agg AS (SELECT feature, category, avg(quality) AS rate, count(*) AS cases
                FROM long WHERE category IS NOT NULL GROUP BY feature, category),
        ranked AS (SELECT *, {_rank('rate DESC NULLS LAST, category', 'feature')} AS rank,
                          greatest(count(*) OVER (PARTITION BY feature) - 5, 0) AS other_categories
                   FROM agg)
        SELECT feature, category, round(rate, 6) AS rate, cases, rank, other_categories
        FROM ranked WHERE rank <= 5""",
    "d12_documents_itemsets": "WITH base AS (SELECT 1)" + _itemsets_sql(
        _DOCS + " WHERE l.quality = 0", _DOC_COLS) + """
        SELECT items_text, size, n, round(support, 6) AS support FROM its""",
    "d13_documents_rules": "WITH base AS (SELECT 1)" + _rules_sql(
        _DOCS + " WHERE l.quality = 0", _DOC_COLS) + _RULES_OUT,
})

ORACLES.update({
    "i10_kmodes_cost": with_cases(_CL_SEED + """
        SELECT CAST(sum(distance) AS BIGINT) AS cost, count(*) AS n_rows FROM asg"""),
})

ORACLES.update({
    "d12_basket_itemsets": """
        WITH b AS (SELECT DISTINCT l.l_orderkey AS o, p.p_name AS i
                   FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
        tot AS (SELECT count(DISTINCT o) AS n FROM b),
        s1 AS (SELECT i AS items_text, 1 AS size, count(*) AS n FROM b GROUP BY i),
        s2 AS (SELECT x.i || ', ' || y.i AS items_text, 2 AS size, count(*) AS n
               FROM b x JOIN b y ON x.o = y.o AND x.i < y.i GROUP BY x.i, y.i),
        s3 AS (SELECT x.i || ', ' || y.i || ', ' || z.i AS items_text, 3 AS size, count(*) AS n
               FROM b x JOIN b y ON x.o = y.o AND x.i < y.i JOIN b z ON y.o = z.o AND y.i < z.i
               GROUP BY x.i, y.i, z.i),
        a AS (SELECT * FROM s1 UNION ALL SELECT * FROM s2 UNION ALL SELECT * FROM s3)
        SELECT items_text, CAST(size AS INTEGER) AS size, n,
               round(n / (SELECT CAST(n AS DOUBLE) FROM tot), 6) AS support
        FROM a WHERE n >= 0.01 * (SELECT n FROM tot)""",
})


# ------------------------------------------------------------ the logistic regression
_LR_CAT = ["sex", "grp_a", "weapon_group", "relation_simple", "region"]
_LR_VOCAB = _SPLIT + f""",
    lr_cats AS ({' UNION ALL '.join(f"SELECT DISTINCT '{c}' AS col, {c} AS category FROM split WHERE split = 'train' AND {c} IS NOT NULL" for c in _LR_CAT)}),
    lr_kept AS (SELECT col, category FROM (SELECT *, row_number() OVER (PARTITION BY col ORDER BY category) AS rn FROM lr_cats) WHERE rn > 1),
    lr_rows AS (SELECT split, 'age' AS feature, coalesce(age, (SELECT avg(age) FROM split WHERE split = 'train')) AS x FROM split
                UNION ALL SELECT split, 'vulnerable', vulnerable FROM split
                {' '.join(f"UNION ALL SELECT split, col || '_' || category, CASE WHEN {c} = category THEN 1 ELSE 0 END FROM split, lr_kept WHERE col = '{c}'" for c in _LR_CAT)})"""

ORACLES.update({
    "i7_encoded_sums": with_cases(f""",{_LR_VOCAB}
        SELECT split, feature, round(sum(x), 3) AS total FROM lr_rows GROUP BY split, feature"""),
    "i7_optimality": with_cases(f""",{_LR_VOCAB}
        SELECT DISTINCT feature, 0.0::DOUBLE AS gradient FROM lr_rows"""),
    "i9_i16_importance_sums": with_cases(f""",{_LR_VOCAB},
        rf_cats AS ({' UNION ALL '.join(f"SELECT least(count(DISTINCT {c}), 15 + 1) - 1 AS n FROM split WHERE split = 'train'" for c in ("sex", "age_category", "weapon_service"))}
                    UNION ALL SELECT 16 - 1)
        SELECT 'tree' AS model, count(DISTINCT feature) AS n_features, CAST(0 AS BIGINT) AS n_negative, 1.0::DOUBLE AS total FROM lr_rows
        UNION ALL SELECT 'forest', CAST(4 + sum(n) AS BIGINT), 0, 1.0 FROM rf_cats"""),
})

# ------------------------------------------------------------ scores of a given coefficient table
ORACLES.update({
    "i21_requests_fixed": with_cases(_responses_sql()),
    "a12_response_json_fixed": with_cases(_responses_sql()),
    "k1_stream_requests_fixed": with_cases(_responses_sql()),
    "a9_model_roundtrip": with_cases("SELECT count(*) AS n_rows, CAST(0 AS BIGINT) AS n_different FROM cases WHERE label IS NOT NULL"),
    "i20_cases_fixed": with_cases(f""",{_FIXED},
        raw AS (SELECT *, record_id % 7 = 0 AS bad FROM fx)
        SELECT CASE WHEN record_id % 5 <> 0 THEN CAST(record_id AS VARCHAR) ELSE 'Unknown' END AS case_id,
               CASE WHEN NOT bad THEN round(p, 6) END AS solvability_probability,
               CASE WHEN NOT bad THEN printf('%.1f%%', p * 100) END AS solvability_percentage,
               CASE WHEN NOT bad THEN {_TIERS} END AS priority_level, CASE WHEN NOT bad THEN {_LIKELY} END AS predicted_outcome,
               CASE WHEN NOT bad THEN {_ADVISED} END AS investigation_recommendation,
               '2024-01-01T00:00:00' AS prediction_timestamp, CASE WHEN bad THEN 'not a number: age' END AS error FROM raw"""),
    "i17_scored_test_fixed": with_cases(f""",{_FIXED}
        SELECT record_id, label AS actual, round(p, 6) AS probability, CAST(p >= 0.5 AS INTEGER) AS predicted, sex, age, weapon,
               region, year, units FROM ev"""),
    "i19_high_potential_fixed": with_cases(f""",{_FIXED}
        SELECT record_id, round(p, 6) AS probability, sex, region, {_rank('round(p, 6) DESC, record_id')} AS rank
        FROM ev WHERE label = 0 AND round(p, 6) > 0.7 ORDER BY round(p, 6) DESC, record_id LIMIT 5"""),
    "d14_d19_fixed": with_cases(f""",{_FIXED},{_CONF},
        pr AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS pp,
                      CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS rr FROM conf)
        SELECT tn, fp, fn, tp, round((tp + tn) / (tp + tn + fp + fn), 6) AS accuracy, round(pp, 6) AS precision, round(rr, 6) AS recall,
               round(CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END, 6) AS f1,
               (SELECT round(auc, 6) FROM ({_auc_sql('ev')})) AS auc FROM pr"""),
    "d17_d20_fixed": with_cases(f""",{_FIXED},
        au AS ({_auc_sql('fs', 'split')}),
        gp AS (SELECT max(CASE WHEN split = 'train' THEN auc END) AS a, max(CASE WHEN split = 'test' THEN auc END) AS b FROM au),
        th AS (SELECT t.threshold, count(*) FILTER (WHERE score >= t.threshold) AS n_at,
                      count(*) FILTER (WHERE score >= t.threshold AND label = 1) AS tp
               FROM ev, (VALUES (0.8::DOUBLE), (0.7), (0.6)) t(threshold) GROUP BY t.threshold)
        SELECT threshold, n_at, tp, round(CASE WHEN n_at > 0 THEN tp / n_at ELSE 0 END, 6) AS precision_at,
               round(a, 6) AS train_auc, round(b, 6) AS test_auc, round(a - b, 6) AS gap FROM th, gp"""),
    "d7_model_score_stats": with_cases(f""",{_FIXED}
        SELECT round(avg(p), 6) AS mean, round(quantile_cont(p, 0.5), 6) AS median, round(min(p), 6) AS min, round(max(p), 6) AS max
        FROM fx WHERE label = 0"""),
    "i5_i15_fold_scores": with_cases(f""",{_FIXED},
        fo AS (SELECT *, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM fs),
        fa AS ({_auc_sql('fo', 'fold')})
        SELECT round(avg(auc), 6) AS mean_auc, round(stddev_pop(auc), 6) AS std_auc, count(*) AS folds,
               (SELECT round(avg(CASE WHEN label = CAST(p >= 0.5 AS INTEGER) THEN 1.0 ELSE 0.0 END), 6) FROM fo) AS accuracy FROM fa"""),
})


# ------------------------------------------------------------ trees as tables, bags, folds, starts, inferred types
def _held(tree: str) -> str:
    """How often the bag holds the row: Poisson(1) from 32 bits of a hash."""
    cuts = [1580030168, 3160060337, 3950075421, 4213413783, 4279248373, 4292415291, 4294609777, 4294923276, 4294962463, 4294966817,
            4294967252, 4294967292, 4294967295]
    h = f"('0x' || substr(md5(CAST(record_id AS VARCHAR) || '|42|' || CAST({tree} AS VARCHAR)), 1, 8))::BIGINT"
    return f"CAST(len([c FOR c IN {cuts}::BIGINT[] IF c <= {h}]) AS INTEGER)"


_NUMBERS = """
    nr AS (SELECT record_id, label, coalesce(age, 0) AS age, coalesce(CAST(units AS DOUBLE), 0) AS units, coalesce(CAST(year AS DOUBLE), 0) AS year
           FROM cases WHERE label IS NOT NULL)"""

#: (node, parent, condition on the rows that go from the parent to it)
_TREE = [(0, None, "TRUE"), (1, 0, "age <= 49"), (6, 0, "age > 49"), (2, 1, "units <= 3"), (5, 1, "units > 3"), (3, 2, "year <= 1994"),
         (4, 2, "year > 1994"), (7, 6, "year <= 1997"), (10, 6, "year > 1997"), (8, 7, "age <= 93"), (9, 7, "age > 93")]


def _tree_sql() -> str:
    way, up = {}, {n: p for n, p, _ in _TREE}
    for n, p, cond in _TREE:
        way[n] = ([] if p is None else way[p]) + [cond]
    counted = " UNION ALL ".join(
        f"SELECT {n} AS node, count(*) AS n, coalesce(sum(label), 0) AS positives, {str(n not in up.values()).upper()} AS last FROM nr WHERE {' AND '.join(w)}"
        for n, w in way.items())
    above = " UNION ALL ".join(f"SELECT {n} AS node, {a} AS above" for n in way for a in _line(n, up))
    return f"""{_NUMBERS}, c AS ({counted}), above AS ({above})
        SELECT CAST(node AS INTEGER) AS node, n, CAST(positives AS BIGINT) AS positives, last OR n < 2500 AS leaf FROM c
        WHERE NOT EXISTS (SELECT 1 FROM above a JOIN c p ON p.node = a.above WHERE a.node = c.node AND p.n < 2500)"""


def _line(node: int, up: dict) -> list:
    return [] if up[node] is None else [up[node], *_line(up[node], up)]


def _huang_sql(k: int = 4, runs: int = 2) -> str:
    """Starts by frequency, then cluster by cluster moved to the nearest tuple."""
    cols = _CL
    counts = " UNION ALL ".join(f"SELECT '{c}' AS col, {c} AS value, sum(w) AS n FROM t GROUP BY {c}" for c in cols)
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in cols)
    sql = _CL_SEED + f""",
    hc AS ({counts}),
    hd AS (SELECT *, -ln((('0x' || substr(md5(col || '|' || value || '|' || CAST(draw AS VARCHAR) || '|42'), 1, 8))::BIGINT + 0.5::DOUBLE)
                         / 4294967296.0::DOUBLE) / n AS key FROM hc, (SELECT unnest(range({k * runs})) AS draw)),
    hw AS (SELECT col, draw, value FROM (SELECT *, row_number() OVER (PARTITION BY col, draw ORDER BY key, value) AS rn FROM hd) WHERE rn = 1),
    h0 AS (SELECT CAST(draw // {k} AS INTEGER) AS run, CAST(draw % {k} AS INTEGER) AS cluster,
                  {', '.join(f"max(CASE WHEN col = '{c}' THEN value END) AS {c}" for c in cols)} FROM hw GROUP BY draw)"""
    for i in range(k):
        sql += f""",
    n{i} AS (SELECT run, {', '.join(cols)} FROM (
        SELECT m.run, {', '.join('t.' + c for c in cols)}, row_number() OVER (PARTITION BY m.run ORDER BY
               EXISTS (SELECT 1 FROM h{i} x WHERE x.run = m.run AND {same('x', 't')}),
               {' + '.join(f"CAST(t.{c} <> m.{c} AS INTEGER)" for c in cols)}, {', '.join('t.' + c for c in cols)}) AS rn
        FROM t, h{i} m WHERE m.cluster = {i}) WHERE rn = 1),
    h{i + 1} AS (SELECT * FROM h{i} WHERE cluster <> {i} UNION ALL SELECT run, {i}, {', '.join(cols)} FROM n{i})"""
    return sql + f" SELECT * FROM h{k}"


def _types_sql() -> str:
    """The narrowest of boolean, bigint, double and text that all values of a column have."""
    cells = {"Record_ID": "CAST(record_id AS VARCHAR)", "Crime_Solved": "outcome", "Item": "item",
             "Victim_Age": "CASE WHEN record_id % 9 = 0 THEN NULL ELSE CAST(age AS VARCHAR) END", "Group_A": "grp_a", "Group_B": "grp_b",
             "State": "region", "Victim_Count": "CAST(units AS VARCHAR)", "Year": "CAST(year AS VARCHAR)", "Month": "month",
             "Price": "CAST(price AS VARCHAR)", "Weapon": "CASE WHEN record_id % 8 > 1 THEN weapon END", "Relationship": "relation",
             "Victim_Sex": "sex", "Late_Text": "CASE WHEN record_id = top THEN '12x' ELSE CAST(record_id AS VARCHAR) END",
             "Late_Number": "CASE WHEN record_id = top THEN '0.5' WHEN record_id % 3 = 0 THEN NULL ELSE CAST(record_id AS VARCHAR) END",
             "Flag": "CASE WHEN record_id % 2 = 0 THEN 'True' ELSE 'False' END", "Nothing": "CAST(NULL AS VARCHAR)"}
    rows = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {x} AS v FROM r" for c, x in cells.items())
    return f""", r AS (SELECT *, max(record_id) OVER () AS top FROM cases), v AS ({rows})
        SELECT "column", CASE WHEN count(v) = 0 THEN 'double' WHEN bool_and(v IS NULL OR lower(v) IN ('true', 'false')) THEN 'boolean'
               WHEN bool_and(v IS NULL OR TRY_CAST(v AS BIGINT) IS NOT NULL AND NOT contains(v, '.')) THEN 'bigint'
               WHEN bool_and(v IS NULL OR TRY_CAST(v AS DOUBLE) IS NOT NULL) THEN 'double' ELSE 'string' END AS type
        FROM v GROUP BY "column" UNION ALL SELECT 'Solved', 'int'"""


ORACLES.update({
    "i13_min_split_nodes": with_cases("," + _tree_sql()),
    "i14_min_split_tree": with_cases(f""",{_SPLIT}
        SELECT count(*) AS n_root, CAST(0 AS BIGINT) AS n_small_splits, CAST(0 AS BIGINT) AS n_different FROM split WHERE split = 'train'"""),
    "i15_bags": with_cases(f""",{_NUMBERS},
        b AS (SELECT record_id, CAST(tree AS INTEGER) AS tree FROM nr, (SELECT unnest(range(50)) AS tree))
        SELECT tree, {_held('tree')} AS times, count(*) AS n FROM b GROUP BY ALL"""),
    "i15_oob_votes_fixed": with_cases(f""",{_NUMBERS},
        says AS (SELECT record_id, label, 0 AS tree, CASE WHEN age <= 39 THEN 0.625 ELSE 0.375 END::DOUBLE AS p FROM nr
                 UNION ALL SELECT record_id, label, 1, CASE WHEN units <= 4 THEN 0.25 ELSE 0.5 END FROM nr
                 UNION ALL SELECT record_id, label, 2, CASE WHEN year <= 1995 THEN 0.875 ELSE 0.125 END FROM nr),
        oob AS (SELECT record_id, label, count(*) AS trees, CAST(avg(p) >= 0.5 AS INTEGER) AS predicted FROM says
                WHERE {_held('tree')} = 0 GROUP BY record_id, label)
        SELECT trees, count(*) AS n_rows, CAST(sum(predicted) AS BIGINT) AS n_predicted,
               round(avg(CASE WHEN label = predicted THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM oob GROUP BY trees"""),
    "i5_optimality": with_cases(f""",{_LR_VOCAB}
        SELECT CAST(f.fold AS INTEGER) AS fold, count(DISTINCT feature) AS n_features, 0.0::DOUBLE AS gradient
        FROM lr_rows, (SELECT unnest(range(5)) AS fold) f GROUP BY f.fold"""),
    "i10_huang_starts": with_cases(_huang_sql()),
    "i10_huang_fit_converged": with_cases("""
        SELECT 5 AS n_modes, 0 AS n_moved, count(*) AS n_rows, CAST(0 AS BIGINT) AS cost_difference FROM cases WHERE label = 0"""),
    "a1_csv_inferred": with_cases(_types_sql()),
    "i2_sparse_sums": with_cases(f""",{_LR_VOCAB}
        SELECT split, feature, round(sum(x), 3) AS total FROM lr_rows GROUP BY split, feature"""),
    "i3_dictionary_codes": ORACLES["i3_label_codes"],
    "i3_customer_codes": """
        SELECT o_orderkey, CAST(dense_rank() OVER (ORDER BY CAST(o_custkey AS VARCHAR)) - 1 AS INTEGER) AS customer_code FROM orders""",
    "k1_stream_answers_fixed": f"""
        SELECT request_id, CASE WHEN error IS NULL THEN 'answers' ELSE 'rejects' END AS place, probability, error
        FROM ({with_cases(_responses_sql())})""",
    "i8_coefficient_ends_fixed": """
        SELECT feature, coef, round(exp(coef), 6) AS odds_ratio FROM (VALUES ('region_rate', 2.0::DOUBLE), ('weapon_service_Firearm', 0.8),
            ('age_category_Child', 0.6), ('sex_Male', 0.4), ('weapon_service_Strangulation', -0.9), ('weapon_service_Knife', -0.5),
            ('age_category_Senior', -0.4), ('sex_Unknown', -0.3)) t(feature, coef)""",
    "i9_stump_split": with_cases(f""",{_LR_VOCAB},
        tr AS (SELECT * FROM split WHERE split = 'train'),
        side AS ({' UNION ALL '.join(f"SELECT k.col || '_' || k.category AS f, coalesce(CAST(tr.{c} = k.category AS INTEGER), 0) AS v, label FROM tr, lr_kept k WHERE k.col = '{c}'" for c in _LR_CAT)}),
        cut AS (SELECT f, v, count(*) AS n, CAST(sum(label) AS BIGINT) AS pos FROM side GROUP BY f, v),
        gain AS (SELECT f, sum(2.0 * pos * (n - pos) / n) AS impurity, count(*) AS sides FROM cut GROUP BY f)
        SELECT f AS split_on, v AS value, n, pos AS positives FROM cut
        WHERE f = (SELECT f FROM gain WHERE sides = 2 ORDER BY impurity, f LIMIT 1)"""),
    "i11_elbow_recomputed": with_cases("""
        SELECT CAST(k AS INTEGER) AS k, (SELECT count(*) FROM cases WHERE label = 0) AS n_rows, 0 AS n_moved, CAST(0 AS BIGINT) AS cost_difference
        FROM (SELECT unnest(range(2, 6)) AS k)"""),
    "b27_documented_ranges": with_cases(_REQ + """
        , forms AS (SELECT *, CASE WHEN ca = 4 THEN 0.0 WHEN ca IN (6, 7) THEN 2.5 WHEN ca IN (9, 10) AND trunc(age) <> 0 THEN trunc(age) END AS a,
            CASE WHEN cv = 4 THEN 0 WHEN cv = 6 THEN 2 WHEN cv = 10 OR (cv = 9 AND units <> 0) THEN units END AS v,
            CASE WHEN cy = 4 THEN 0 WHEN cy = 6 THEN 2 WHEN cy IN (9, 10) THEN year END AS y FROM codes)
        SELECT f.request_id, CASE WHEN rq.error IS NOT NULL OR a < 0 OR a > 100 OR v < 1 OR y < 1980 OR y > 2025
               THEN 'Données numériques invalides' END AS error
        FROM forms f JOIN rq ON f.request_id = rq.request_id"""),
})

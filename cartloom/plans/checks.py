"""One SQL statement per registered query, written against the given tables only.

The statements share the bindings of ``bindings.py`` as CTEs and nothing else
with the jobs they check.
"""

from __future__ import annotations

import re

SUPPORT, CONFIDENCE = 0.005, 0.1
PART_SUPPORT = 0.00015

# --- bindings ----------------------------------------------------------------------------

LINES = """lines AS (
  SELECT l_orderkey AS basket_id, l_partkey AS item, l_quantity AS quantity,
         CASE WHEN l_returnflag = 'R' THEN -l_quantity ELSE l_quantity END AS signed,
         l_linenumber, l_partkey, l_suppkey
  FROM lineitem)"""

PHONES = """padded_key AS (
  SELECT *, lpad(o_custkey::VARCHAR, 12, '0') AS k FROM orders),
bound AS (
  SELECT o_orderkey AS id, o_custkey AS customer, o_orderdate AS day,
    CASE substr(o_orderpriority, 1, 1)
      WHEN '1' THEN '+7 (9' || substr(k, 1, 2) || ') ' || substr(k, 3, 4) || '-' || substr(k, 7, 6)
      WHEN '2' THEN '8-9' || substr(k, 1, 2) || '-' || substr(k, 3, 4) || '-' || substr(k, 7, 6)
      ELSE '79' || k END AS phone
  FROM padded_key),
clients AS (
  SELECT *, regexp_replace(phone, '[^0-9]', '', 'g') AS digits FROM bound),
users AS (
  SELECT *, ((digits::HUGEINT % 2147483648) * 67853 % 2147483648)::INTEGER AS tel_hashed FROM clients)"""

RATINGS = PHONES + """,
ratings AS (
  SELECT tel_hashed, l_partkey AS goods_id, sum(l_quantity) AS purchases
  FROM lineitem JOIN users ON id = l_orderkey GROUP BY 1, 2),
parts AS (
  SELECT *, CASE WHEN (tel_hashed::BIGINT * 67853 + goods_id * 31) % 10 < 8
                 THEN 'train' ELSE 'test' END AS part FROM ratings)"""

CATALOGUE = """cat AS (
  SELECT p_partkey AS id, p_name AS name, CASE WHEN p_size <= 37 THEN p_name END AS trade,
         p_type AS form, p_brand AS company,
         CASE WHEN p_size > 10 THEN left(p_type, 1) || lpad(p_size::VARCHAR, 2, '0') END AS atx
  FROM part)"""

FORMS = """forms(form, equal_form) AS (
  VALUES ('ECONOMY', 'ECONOMY'), ('ECONOMY', 'PROMO'), ('PROMO', 'PROMO'), ('PROMO', 'ECONOMY'),
         ('SMALL', 'MEDIUM'), ('MEDIUM', 'SMALL'), ('LARGE', 'LARGE'))"""

HOLD_OUT = """dated AS (
  SELECT lines.*, o_orderdate >= TIMESTAMP '2000-01-01' AS held_out
  FROM lines JOIN orders ON o_orderkey = basket_id),
history AS (SELECT * FROM dated WHERE NOT held_out),
held AS (SELECT * FROM dated WHERE held_out)"""


# --- itemsets and rules ------------------------------------------------------------------


def itemsets(pairs: str, support: float) -> str:
    """CTEs up to ``sets(items, freq)`` by self-joins, to size 4."""
    return f"""pairs AS MATERIALIZED (SELECT DISTINCT basket_id, item FROM ({pairs})),
total AS (SELECT count(DISTINCT basket_id) AS n FROM pairs),
least AS (SELECT ceil({support} * n) AS c FROM total),
good AS (SELECT item FROM pairs GROUP BY 1 HAVING count(*) >= (SELECT c FROM least)),
p AS MATERIALIZED (SELECT * FROM pairs WHERE item IN (SELECT item FROM good)),
s1 AS (SELECT [item] AS items, count(*) AS freq FROM p GROUP BY item),
s2 AS MATERIALIZED (SELECT [a.item, b.item] AS items, count(*) AS freq
  FROM p a JOIN p b ON a.basket_id = b.basket_id AND a.item < b.item
  GROUP BY a.item, b.item HAVING count(*) >= (SELECT c FROM least)),
s3 AS MATERIALIZED (SELECT [a.item, b.item, c.item] AS items, count(*) AS freq
  FROM p a JOIN p b ON a.basket_id = b.basket_id AND a.item < b.item
  JOIN p c ON a.basket_id = c.basket_id AND b.item < c.item
  GROUP BY a.item, b.item, c.item HAVING count(*) >= (SELECT c FROM least)),
s4 AS MATERIALIZED (SELECT [a.item, b.item, c.item, d.item] AS items, count(*) AS freq
  FROM p a JOIN p b ON a.basket_id = b.basket_id AND a.item < b.item
  JOIN p c ON a.basket_id = c.basket_id AND b.item < c.item
  JOIN p d ON a.basket_id = d.basket_id AND c.item < d.item
  GROUP BY a.item, b.item, c.item, d.item HAVING count(*) >= (SELECT c FROM least)),
sets AS MATERIALIZED (SELECT items, freq FROM s1 UNION ALL SELECT items, freq FROM s2
         UNION ALL SELECT items, freq FROM s3 UNION ALL SELECT items, freq FROM s4)"""


BRAND_PAIRS = "SELECT l_orderkey AS basket_id, p_brand AS item FROM lineitem JOIN part ON p_partkey = l_partkey"
NUMBER_PAIRS = (
    "SELECT l_orderkey AS basket_id, regexp_extract(p_brand, '[0-9]+')::BIGINT AS item "
    "FROM lineitem JOIN part ON p_partkey = l_partkey"
)
PART_PAIRS = "SELECT l_orderkey AS basket_id, l_partkey AS item FROM lineitem"


def rules(pairs: str, support: float = SUPPORT, confidence: float = CONFIDENCE) -> str:
    """CTEs up to ``rules``, every split of every itemset."""
    return itemsets(pairs, support) + f""",
ways AS (SELECT items, freq, unnest(range(1, (1 << len(items)) - 1)) AS way FROM sets WHERE len(items) > 1),
cuts AS (SELECT freq,
  [x FOR x, i IN items IF (way >> (i - 1)) & 1 = 1] AS antecedent,
  [x FOR x, i IN items IF (way >> (i - 1)) & 1 = 0] AS consequent FROM ways),
rules AS (SELECT antecedent, consequent, cuts.freq / fa.freq AS confidence,
    (cuts.freq / fa.freq) / (fc.freq / n) AS lift, cuts.freq / n AS support,
    cuts.freq / n - (fa.freq / n) * (fc.freq / n) AS leverage,
    CASE WHEN cuts.freq <> fa.freq
         THEN (1 - fc.freq / n) / (1 - cuts.freq / fa.freq) END AS conviction
  FROM cuts JOIN sets fa ON fa.items = antecedent JOIN sets fc ON fc.items = consequent, total
  WHERE cuts.freq / fa.freq >= {confidence})"""


def text(items: str) -> str:
    return f"array_to_string({items}, ',')"


SIDES = f"{text('antecedent')} AS antecedent, {text('consequent')} AS consequent"
ONE_RIGHT = "len(consequent) = 1"

# --- item similarity and baskets ---------------------------------------------------------


def cosine(source: str, user: str) -> str:
    """CTEs up to ``sims(item_a, item_b, cosine)``, 64 per item."""
    return f"""ui AS MATERIALIZED (SELECT DISTINCT {user} AS u, item AS i FROM {source}),
ni AS (SELECT i, count(*) AS n FROM ui GROUP BY i),
common AS (SELECT a.i AS item_a, b.i AS item_b, count(*) AS c
  FROM ui a JOIN ui b ON a.u = b.u AND a.i <> b.i GROUP BY 1, 2),
cosines AS (SELECT item_a, item_b, c / sqrt(x.n::DOUBLE * y.n::DOUBLE) AS cosine
  FROM common JOIN ni x ON x.i = item_a JOIN ni y ON y.i = item_b),
sims AS MATERIALIZED (SELECT * FROM cosines
  QUALIFY row_number() OVER (PARTITION BY item_a ORDER BY round(cosine, 12) DESC, item_b) <= 64)"""


def recommend(owned: str, name: str = "recs") -> str:
    """CTEs up to ``recs(u, item, score, rnk)`` over ``owned(u, i)``."""
    return f"""sums AS (
  SELECT u, item_b AS item, sum(round(cosine * 1000000000)::BIGINT)::BIGINT AS w
  FROM {owned} o JOIN sims ON item_a = o.i GROUP BY 1, 2),
unknown AS (SELECT * FROM sums s
  WHERE w > 0 AND NOT EXISTS (SELECT 1 FROM {owned} o WHERE o.u = s.u AND o.i = s.item)),
sizes AS (SELECT u, count(*) AS n FROM {owned} GROUP BY u),
{name} AS (SELECT u, item, w / 1000000000.0::DOUBLE / n AS score,
    row_number() OVER (PARTITION BY u ORDER BY w DESC, item) AS rnk
  FROM unknown JOIN sizes USING (u))"""


def nearest(queries: str, stored: str, apart: str = "true") -> str:
    """CTEs up to ``near(query_id, basket_id, overlap, size)``."""
    return f"""q AS (SELECT DISTINCT query_id, item FROM ({queries})),
held_items AS (SELECT DISTINCT basket_id, item FROM {stored}),
basket_sizes AS (SELECT basket_id, count(*) AS size FROM {stored} GROUP BY 1),
shared AS (SELECT query_id, basket_id, count(*) AS overlap
  FROM q JOIN held_items USING (item) WHERE {apart} GROUP BY 1, 2),
near AS MATERIALIZED (SELECT * FROM shared JOIN basket_sizes USING (basket_id)
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, size, basket_id) = 1)"""


POPULAR = """popular AS (SELECT item, row_number() OVER (ORDER BY qty DESC, item) AS place FROM qty QUALIFY place <= 5)"""
ANSWERED = """SELECT query_id, recs.item, round(score, 6) AS score, 'basket' AS source, rnk
FROM near JOIN recs ON u = basket_id WHERE rnk <= 10"""
TRAINED = f"{LINES},\n{HOLD_OUT},\n{cosine('history', 'basket_id')}"
HISTORY_OWNED = "(SELECT DISTINCT basket_id AS u, item AS i FROM history WHERE basket_id IN (SELECT basket_id FROM near))"
ENDS = """ends AS (SELECT basket_id, count(*) AS n,
    first(item ORDER BY l_linenumber, l_partkey, l_suppkey) AS first_item,
    last(item ORDER BY l_linenumber, l_partkey, l_suppkey) AS last_item FROM {0} GROUP BY 1),
numbered AS (SELECT basket_id, item,
    row_number() OVER (PARTITION BY basket_id ORDER BY l_linenumber, l_partkey, l_suppkey) AS pos,
    count(*) OVER (PARTITION BY basket_id) AS n FROM {0})"""

# --- names -------------------------------------------------------------------------------


def lcs(pairs: str) -> str:
    """Recursive CTE ``lcs(a, b, common)`` over ``pairs(a, b)``, one character of a per step."""
    return f"""steps(a, b, i, line) AS (
  SELECT a, b, 0, [0 FOR x IN range(0, length(b) + 1)] FROM {pairs}
  UNION ALL
  SELECT a, b, i + 1,
    [list_max([CASE WHEN k = 1 THEN 0 ELSE greatest(line[k],
        line[k - 1] + CASE WHEN substr(b, k - 1, 1) = substr(a, i + 1, 1) THEN 1 ELSE 0 END) END
      FOR k IN range(1, j + 1)]) FOR j IN range(1, length(b) + 2)]
  FROM steps WHERE i < length(a)),
lcs AS (SELECT a, b, line[length(b) + 1] AS common FROM steps WHERE i = length(a))"""


def token_set(left: str, right: str) -> str:
    """CTEs up to ``scores(x, y, score)``: the token-set score of all pairs of distinct names."""
    tok = "list_sort(list_distinct(string_split({0}, ' ')))"
    return f"""name_pairs AS (SELECT x, y, {tok.format('x')} AS tx, {tok.format('y')} AS ty
  FROM (SELECT DISTINCT name AS x FROM {left}), (SELECT DISTINCT name AS y FROM {right})),
sides AS (SELECT x, y,
    array_to_string([t FOR t IN tx IF list_contains(ty, t)], ' ') AS t0,
    array_to_string([t FOR t IN tx IF list_contains(ty, t)] || [t FOR t IN tx IF NOT list_contains(ty, t)], ' ') AS t1,
    array_to_string([t FOR t IN tx IF list_contains(ty, t)] || [t FOR t IN ty IF NOT list_contains(tx, t)], ' ') AS t2
  FROM name_pairs),
lcs_pairs AS (SELECT DISTINCT t1 AS a, t2 AS b FROM sides),
{lcs('lcs_pairs')},
scores AS (SELECT x, y, greatest(
    CASE WHEN t0 = '' THEN 0 ELSE round_even(100.0::DOUBLE * (2 * length(t0) / (length(t0) + length(t1))), 0) END,
    CASE WHEN t0 = '' THEN 0 ELSE round_even(100.0::DOUBLE * (2 * length(t0) / (length(t0) + length(t2))), 0) END,
    round_even(100.0::DOUBLE * (2 * common / (length(t1) + length(t2))), 0))::INTEGER AS score
  FROM sides JOIN lcs ON a = t1 AND b = t2)"""


def matches(cutoff: int) -> str:
    """CTEs up to ``found(id, similar_id, name, company, score)`` for products without a code."""
    return f"""{CATALOGUE},
{FORMS},
asked AS (SELECT id, coalesce(trade, name) AS asked_name, name AS own_name FROM cat WHERE atx IS NULL),
named AS (SELECT trade AS n, form FROM cat WHERE trade IS NOT NULL UNION SELECT name, form FROM cat),
reach AS (SELECT DISTINCT asked.id, equal_form FROM asked JOIN named ON n = asked_name
  JOIN forms ON forms.form = named.form),
{token_set('cat', 'cat')},
shelf AS (SELECT DISTINCT form, name FROM cat),
hits AS (SELECT DISTINCT asked.id, shelf.name, score FROM asked JOIN reach ON reach.id = asked.id
  JOIN shelf ON shelf.form = equal_form
  JOIN scores ON x = own_name AND y = shelf.name WHERE score >= {cutoff}),
first_rows AS (SELECT name, min(id) AS similar_id, arg_min(company, id) AS company FROM cat GROUP BY 1),
found AS (SELECT hits.id, similar_id, hits.name, company, score FROM hits JOIN first_rows USING (name)
  WHERE hits.id <> similar_id)"""


def spread(limit: int) -> str:
    """CTEs up to ``chosen``, the company-diversified best rows of ``found``."""
    return f"""sized AS (SELECT *, count(*) OVER (PARTITION BY id) AS n,
    row_number() OVER (PARTITION BY id, company ORDER BY score DESC, similar_id) AS place FROM found),
companies AS (SELECT id, ceil({limit} / count(DISTINCT company)) AS share FROM found GROUP BY 1),
flagged AS (SELECT *, CASE WHEN n <= {limit} OR share <= 1 OR place <= share THEN 0 ELSE 1 END AS late
  FROM sized JOIN companies USING (id)),
placed AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY late, score DESC, similar_id) AS rnk FROM flagged),
chosen AS (SELECT * FROM placed WHERE rnk <= {limit})"""


def again(ctes: str) -> str:
    """The CTEs of ``spread`` under other names."""
    return re.sub(r"\b(sized|companies|flagged|placed|chosen)\b", r"\1_again", ctes)


BY_CODE = """coded AS (SELECT id, name, left(atx, length(atx) - 1) AS stem FROM cat WHERE atx <> ''),
siblings AS (SELECT a.id, b.id AS similar_id, b.name,
    row_number() OVER (PARTITION BY a.id ORDER BY b.id) AS place
  FROM coded a JOIN coded b ON a.stem = b.stem AND a.id <> b.id)"""

def second(ctes: str) -> str:
    """The CTEs of ``nearest`` under other names."""
    return re.sub(r"\b(q|held_items|basket_sizes|shared|near)\b", r"\1_second", ctes)


PLAIN = "regexp_replace({0}, '<[^>]*>', '', 'g')"
for _from, _to in [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")]:
    PLAIN = f"replace({PLAIN}, '{_from}', '{_to}')"
PLAIN = f"regexp_replace({PLAIN}, '^\\s+|\\s+$', '', 'g')"

TOP = """qty AS (SELECT item, sum(quantity::BIGINT)::BIGINT AS qty FROM lines GROUP BY 1),
top AS (SELECT item, qty, row_number() OVER (ORDER BY qty DESC, item) AS rnk FROM qty)"""

KEPT = f"""WITH {LINES},
{TOP},
kept AS (SELECT basket_id FROM lines WHERE item IN (SELECT item FROM top WHERE rnk <= 1000)
  GROUP BY 1 HAVING count(DISTINCT item) > 2)"""

CHECKS: dict[str, str] = {
    "orders_json_roundtrip": 'SELECT l_orderkey AS id, l_partkey AS "goodsId", l_quantity AS quantity FROM lineitem',
    "orders_feed_clean": "SELECT l_orderkey AS id, count(*) AS n_lines FROM lineitem GROUP BY 1",
    "catalog_csv_roundtrip": f'WITH {CATALOGUE} SELECT id, name AS normalized_name, form AS "medForm", atx FROM cat',
    "sales_tsv_roundtrip": 'SELECT l_orderkey AS receipt_number, l_partkey AS "goodsId", l_quantity AS quantity FROM lineitem',
    "rules_csv_roundtrip": f"WITH {rules(NUMBER_PAIRS)} SELECT {SIDES}, round(confidence, 6) AS confidence FROM rules",
    "rules_as_json": f"WITH {rules(BRAND_PAIRS)} SELECT {text('antecedent')} AS antecedent, consequent[1] AS consequent, round(confidence * 1e6)::BIGINT AS confidence_x1e6 FROM rules WHERE {ONE_RIGHT}",
    "model_roundtrip": f"WITH {rules(BRAND_PAIRS)} SELECT count(*) AS n_rules FROM rules WHERE {ONE_RIGHT}",
    "orders_stream_ingest": f"""WITH {PHONES}, sizes AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1)
SELECT id, phone AS "clientTel", coalesce(n, 0) AS n_lines FROM bound LEFT JOIN sizes ON l_orderkey = id""",
    "phone_length_profile": f"WITH {PHONES} SELECT length(phone) AS len, count(*) AS n, min(phone) AS example FROM bound GROUP BY 1",
    "phone_digits": f"WITH {PHONES} SELECT id, digits FROM clients",
    "phone_hash": f"WITH {PHONES} SELECT id, tel_hashed FROM users",
    "dedupe_orders": f"WITH {PHONES} SELECT id, least(phone, digits) AS client FROM clients",
    "returning_customer_ratio": f"WITH {PHONES} SELECT round(count(DISTINCT digits) / count(*), 6) AS ratio FROM clients",
    "basket_lines": 'SELECT l_orderkey AS id, l_partkey AS "goodsId", l_quantity AS quantity FROM lineitem',
    "baskets": f"SELECT basket_id AS id, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM ({BRAND_PAIRS}) GROUP BY 1",
    "baskets_net": f"""WITH {LINES},
net AS (SELECT basket_id, item FROM lines GROUP BY 1, 2 HAVING sum(signed) >= 1)
SELECT basket_id AS id, string_agg(item::VARCHAR, ',' ORDER BY item) AS items FROM net GROUP BY 1""",
    "implicit_ratings": f"WITH {RATINGS} SELECT tel_hashed, goods_id, purchases FROM ratings",
    "basket_item_counts": "SELECT l_orderkey AS basket_id, l_partkey AS goods_id, sum(l_quantity)::BIGINT AS purchase_count FROM lineitem GROUP BY 1, 2",
    "basket_padded": f"""WITH {LINES},
arrays AS (SELECT basket_id, list(item ORDER BY l_linenumber, l_partkey, l_suppkey) AS xs FROM lines GROUP BY 1),
width AS (SELECT max(len(xs)) AS w FROM arrays)
SELECT basket_id AS id, {text('xs || [-1 FOR i IN range(0, w - len(xs))]')} AS padded FROM arrays, width""",
    "one_hot_basket": f"""WITH {LINES},
net AS (SELECT basket_id, lower(p_type) AS kind, sum(signed) AS s FROM lines JOIN part ON p_partkey = item GROUP BY 1, 2)
SELECT basket_id AS id, """ + ", ".join(
        f"CASE WHEN coalesce(sum(s) FILTER (kind = '{k}'), 0) <= 0 THEN 0 "
        f"WHEN sum(s) FILTER (kind = '{k}') >= 1 THEN 1 END AS {k}"
        for k in ["economy", "large", "medium", "promo", "small", "standard"]
    ) + " FROM net GROUP BY 1",
    "popularity_topk": f"WITH {LINES}, {TOP} SELECT item AS goods_id, qty, rnk FROM top WHERE rnk <= 100",
    "popularity_two_sources": f"WITH {LINES}, {TOP} SELECT item AS goods_id, qty FROM qty",
    "distinct_products": "SELECT count(DISTINCT l_partkey) AS n FROM lineitem",
    "popular_baskets_distinct": KEPT + """,
numbers AS (SELECT basket_id, -row_number() OVER (ORDER BY basket_id) AS receipt_number FROM kept)
SELECT receipt_number, item AS goods_id FROM lines JOIN numbers USING (basket_id)""",
    "popular_baskets_lines": f"""WITH {LINES}, {TOP},
kept AS (SELECT basket_id FROM lines WHERE item IN (SELECT item FROM top WHERE rnk <= 500)
  GROUP BY 1 HAVING count(*) > 2)
SELECT basket_id AS receipt_number, item AS goods_id FROM lines WHERE basket_id IN (SELECT basket_id FROM kept)""",
    "dataset_counts": KEPT + " SELECT count(*) AS n_rows, count(DISTINCT basket_id) AS n_receipts FROM lines WHERE basket_id IN (SELECT basket_id FROM kept)",
    "frequent_itemsets": f"WITH {itemsets(BRAND_PAIRS, SUPPORT)} SELECT {text('items')} AS items, freq FROM sets",
    "rules_single": f"WITH {rules(BRAND_PAIRS)} SELECT {SIDES}, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(support, 6) AS support FROM rules WHERE {ONE_RIGHT}",
    "rules_all_splits": f"WITH {rules(BRAND_PAIRS)} SELECT {SIDES}, round(confidence, 6) AS confidence, round(lift, 6) AS lift, round(support, 6) AS support, round(leverage, 6) AS leverage, round(conviction, 6) AS conviction FROM rules",
    "rules_strict": f"WITH {rules(BRAND_PAIRS)} SELECT {SIDES}, round(confidence, 6) AS confidence, round(lift, 6) AS lift FROM rules WHERE support >= 0.01 AND confidence >= 0.15 AND lift >= 1.0",
    "rules_for_product": f"WITH {rules(BRAND_PAIRS)} SELECT product, {SIDES}, round(confidence, 6) AS confidence, row_number() OVER (PARTITION BY product ORDER BY confidence DESC, antecedent, consequent) AS rule_rank FROM (SELECT DISTINCT p_brand AS product FROM part) JOIN rules ON list_contains(antecedent, product) WHERE {ONE_RIGHT}",
    "rules_for_basket": f"""WITH {rules(BRAND_PAIRS)},
met AS (SELECT sets.items AS wanted, rules.* FROM sets JOIN rules ON list_has_all(antecedent, sets.items))
SELECT {text('wanted')} AS query, {text('consequent')} AS products, round(confidence, 6) AS confidence,
  row_number() OVER (PARTITION BY wanted ORDER BY confidence DESC, antecedent, consequent) AS rule_rank FROM met""",
    "rules_with_names": f"""WITH {rules(PART_PAIRS, PART_SUPPORT, 0.0)},
numbered AS (SELECT row_number() OVER () AS r, * FROM rules WHERE {ONE_RIGHT}),
left_items AS (SELECT r, unnest(antecedent) AS i, unnest(range(1, len(antecedent) + 1)) AS pos FROM numbered),
left_names AS (SELECT r, string_agg(p_name, ',' ORDER BY pos) AS names FROM left_items JOIN part ON p_partkey = i GROUP BY 1)
SELECT names AS antecedent_names, p_name AS consequent_names, round(confidence, 6) AS confidence
FROM numbered JOIN left_names USING (r) JOIN part ON p_partkey = consequent[1]""",
    "item_cosine": f"WITH {LINES}, sold AS (SELECT o_custkey AS customer, item FROM lines JOIN orders ON o_orderkey = basket_id), {cosine('sold', 'customer')} SELECT item_a, item_b, round(cosine, 6) AS cosine FROM sims",
    "item_cosine_recommend": f"WITH {LINES}, sold AS (SELECT o_custkey AS customer, item FROM lines JOIN orders ON o_orderkey = basket_id), {cosine('sold', 'customer')}, {recommend('ui')} SELECT u AS user, item, round(score, 6) AS score, rnk FROM recs WHERE rnk <= 10",
    "nearest_basket": f"WITH {LINES}, {nearest('SELECT basket_id AS query_id, item FROM lines', 'lines', 'query_id <> basket_id')} SELECT query_id, basket_id, overlap, size FROM near",
    "recommend_with_fallback": f"""WITH {TRAINED},
{nearest('SELECT basket_id AS query_id, item FROM held', 'history')},
{recommend(HISTORY_OWNED)},
qty AS (SELECT item, sum(quantity::BIGINT) AS qty FROM history GROUP BY 1),
{POPULAR}
{ANSWERED}
UNION ALL SELECT o_orderkey, item, 0.0, 'popular', place FROM orders, popular
WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderkey NOT IN (SELECT basket_id FROM held)""",
    "recommend_last_trial": f"""WITH {TRAINED},
{nearest('SELECT basket_id AS query_id, CASE WHEN basket_id % 7 = 0 THEN -item ELSE item END AS item FROM held', 'history')},
{recommend(HISTORY_OWNED)},
qty AS (SELECT item, sum(quantity::BIGINT) AS qty FROM history GROUP BY 1),
{POPULAR}
{ANSWERED}
UNION ALL SELECT o_orderkey, item, 0.0, 'popular', place FROM orders, popular
WHERE o_orderdate >= TIMESTAMP '2000-01-01' AND o_orderkey NOT IN (SELECT query_id FROM near)""",
    "als_topn": f"WITH {RATINGS} SELECT DISTINCT tel_hashed AS user, 3::BIGINT AS n_recs FROM ratings",
    "factor_model_roundtrip": f"WITH {RATINGS} SELECT DISTINCT tel_hashed AS user, 2::BIGINT AS n_recs FROM ratings",
    "als_user_lookup": f"WITH {RATINGS} SELECT DISTINCT phone, 3::BIGINT AS n_recs FROM users WHERE tel_hashed IN (SELECT tel_hashed FROM ratings)",
    "als_rmse": f"""WITH {RATINGS}, train AS (SELECT * FROM parts WHERE part = 'train')
SELECT count(*) AS n_test, 1::BIGINT AS rmse_is_finite FROM parts WHERE part = 'test'
  AND tel_hashed IN (SELECT tel_hashed FROM train) AND goods_id IN (SELECT goods_id FROM train)""",
    "rmse_item_mean": f"""WITH {RATINGS}, means AS (SELECT goods_id, avg(purchases) AS m FROM parts WHERE part = 'train' GROUP BY 1)
SELECT round(sqrt(avg((purchases - m) * (purchases - m))), 6) AS rmse FROM parts JOIN means USING (goods_id) WHERE part = 'test'""",
    "train_test_split": f"WITH {RATINGS} SELECT part, count(*) AS n FROM parts GROUP BY 1",
    "similar_by_code": f"WITH {CATALOGUE}, {BY_CODE} SELECT id, similar_id, 1.0::DOUBLE AS score FROM siblings WHERE place <= 5",
    "dosage_form_expand": f"""WITH {CATALOGUE}, {FORMS},
asked AS (SELECT id, coalesce(trade, name) AS asked_name FROM cat WHERE atx IS NULL),
named AS (SELECT trade AS n, form FROM cat WHERE trade IS NOT NULL UNION SELECT name, form FROM cat)
SELECT DISTINCT asked.id, equal_form AS candidate_form FROM asked JOIN named ON n = asked_name JOIN forms ON forms.form = named.form""",
    "fuzzy_token_set_pairs": f"WITH RECURSIVE {CATALOGUE}, {token_set('cat', 'cat')} SELECT x AS name_a, y AS name_b, score FROM scores WHERE x < y AND score >= 75",
    "similar_fuzzy": f"WITH RECURSIVE {matches(80)} SELECT id, similar_id, score FROM found",
    "similar_diversified": f"WITH RECURSIVE {matches(60)}, {spread(5)} SELECT id, similar_id, score, rnk FROM chosen",
    "similar_products": f"""WITH RECURSIVE {matches(80)}, {spread(5)}, {BY_CODE}
SELECT id, similar_id, name, round(score / 100, 6) AS score FROM chosen
UNION ALL SELECT id, similar_id, name, 1.0 FROM siblings WHERE place <= 5""",
    "similar_products_requests": f"""WITH RECURSIVE {matches(80)}, {spread(2)}, {again(spread(4))}, {BY_CODE}
SELECT id * 10 + 2 AS request, id, similar_id, name, round(score / 100, 6) AS score FROM chosen
UNION ALL SELECT id * 10 + 4, id, similar_id, name, round(score / 100, 6) FROM chosen_again
UNION ALL SELECT id * 10 + most, id, similar_id, name, 1.0 FROM siblings, (VALUES (2), (4)) AS t(most) WHERE place <= most""",
    "similar_count_stats": f"""WITH RECURSIVE {matches(75)}, {BY_CODE},
pairs_of AS (SELECT id, similar_id FROM found UNION ALL SELECT id, similar_id FROM siblings)
SELECT cat.id, count(similar_id) AS n_similar FROM cat LEFT JOIN pairs_of ON pairs_of.id = cat.id GROUP BY 1""",
    "code_enrichment": f"""WITH RECURSIVE {CATALOGUE},
dict AS (SELECT name || 's' AS key, min(atx) AS atx FROM cat WHERE atx IS NOT NULL GROUP BY 1),
asked AS (SELECT id, CASE WHEN contains(form, 'ECONOMY') OR contains(form, 'SMALL') OR contains(form, 'LARGE')
    OR contains(form, 'PROM') THEN coalesce(trade, name) END AS wanted FROM cat WHERE atx IS NULL),
lcs_pairs AS (SELECT DISTINCT wanted AS a, key AS b FROM asked, dict WHERE wanted IS NOT NULL),
{lcs('lcs_pairs')},
best AS (SELECT a, b, round_even(100.0::DOUBLE * (2 * common / (length(a) + length(b))), 0) AS score FROM lcs WHERE score >= 90
  QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, b) = 1)
SELECT asked.id, dict.atx FROM asked LEFT JOIN best ON a = wanted LEFT JOIN dict ON key = b""",
    "code_enrichment_weighted": f"""WITH RECURSIVE {CATALOGUE},
dict AS (SELECT name || 's' AS key, min(atx) AS atx FROM cat WHERE atx IS NOT NULL GROUP BY 1),
asked AS (SELECT id, CASE WHEN contains(form, 'ECONOMY') OR contains(form, 'SMALL') OR contains(form, 'LARGE')
    OR contains(form, 'PROM') THEN coalesce(trade, name) END AS wanted FROM cat WHERE atx IS NULL),
split AS (SELECT x, y, string_split(x, ' ') AS sx, string_split(y, ' ') AS sy,
    list_sort(list_distinct(string_split(x, ' '))) AS tx, list_sort(list_distinct(string_split(y, ' '))) AS ty
  FROM (SELECT DISTINCT wanted AS x, key AS y FROM asked, dict WHERE wanted IS NOT NULL)),
sides AS MATERIALIZED (SELECT x, y, len(sx) AS words, array_to_string(list_sort(sx), ' ') AS ox, array_to_string(list_sort(sy), ' ') AS oy,
    array_to_string([t FOR t IN tx IF list_contains(ty, t)], ' ') AS t0,
    array_to_string([t FOR t IN tx IF list_contains(ty, t)] || [t FOR t IN tx IF NOT list_contains(ty, t)], ' ') AS t1,
    array_to_string([t FOR t IN tx IF list_contains(ty, t)] || [t FOR t IN ty IF NOT list_contains(tx, t)], ' ') AS t2,
    greatest(length(x), length(y)) / least(length(x), length(y)) AS gap FROM split),
lcs_pairs AS MATERIALIZED (SELECT x AS a, y AS b FROM sides UNION SELECT ox, oy FROM sides UNION SELECT t1, t2 FROM sides),
{lcs('lcs_pairs')},
ratios AS MATERIALIZED (SELECT a, b, round_even(100.0::DOUBLE * (2 * common / (length(a) + length(b))), 0) AS r FROM lcs),
parts_of AS (SELECT x, y, words, gap, plain.r AS plain, sorted.r AS sorted, greatest(sets.r,
    CASE WHEN t0 = '' THEN 0 ELSE round_even(100.0::DOUBLE * (2 * length(t0) / (length(t0) + length(t1))), 0) END,
    CASE WHEN t0 = '' THEN 0 ELSE round_even(100.0::DOUBLE * (2 * length(t0) / (length(t0) + length(t2))), 0) END) AS as_set
  FROM sides JOIN ratios plain ON plain.a = x AND plain.b = y JOIN ratios sorted ON sorted.a = ox AND sorted.b = oy
  JOIN ratios sets ON sets.a = t1 AND sets.b = t2),
scored AS (SELECT x, y, CASE WHEN words NOT BETWEEN 2 AND 5 THEN plain
    WHEN gap < 1.5 THEN round_even(greatest(plain, sorted * 0.95::DOUBLE, as_set * 0.95::DOUBLE), 0)
    WHEN gap <= 8 AND (contains(x, y) OR contains(y, x)) THEN 90 ELSE 0 END AS score FROM parts_of),
best AS (SELECT x, y FROM scored WHERE score >= 90 QUALIFY row_number() OVER (PARTITION BY x ORDER BY score DESC, y) = 1)
SELECT asked.id, dict.atx FROM asked LEFT JOIN best ON x = wanted LEFT JOIN dict ON key = y""",
    "sample_products": """WITH ranked AS (
  SELECT p_partkey AS id, row_number() OVER (ORDER BY p_partkey) - 1 AS place, count(*) OVER () AS total FROM part),
spread AS (SELECT j, (j + 43) * 48271 % 2147483647 AS x FROM range(200) AS t(j)),
draws AS (SELECT j AS draw, x * x % 2147483647 * 69621 % 2147483647 AS h FROM spread)
SELECT draw, id FROM draws JOIN ranked ON place = h % total""",
    "category_path_export": """WITH cats AS (
  SELECT 'N' || n_nationkey AS id, n_name AS name, 'R' || n_regionkey AS parent FROM nation
  UNION ALL SELECT 'R' || r_regionkey, r_name, CASE WHEN r_name <> 'AFRICA' THEN 'ROOT' END FROM region
  UNION ALL SELECT 'ROOT', 'WORLD', NULL)
SELECT c_custkey AS sku, c_name AS name, coalesce(nullif(c_mktsegment, 'MACHINERY'), '-') AS brand,
  concat_ws('/', c3.name, c2.name, c1.name) AS path
FROM customer JOIN cats c3 ON c3.id = 'N' || c_nationkey
LEFT JOIN cats c2 ON c2.id = c3.parent LEFT JOIN cats c1 ON c1.id = c2.parent WHERE c_acctbal >= 0""",
    "page_links": f"""WITH found AS (SELECT page_id, regexp_extract_all(html, '(?is)<a\\b[^>]*>(.*?)</a>', 1) AS xs FROM pages),
rows AS (SELECT page_id, unnest(range(0, len(xs))) AS pos, unnest(xs) AS x FROM found)
SELECT page_id, pos, {PLAIN.format('x')} AS anchor_text FROM rows""",
    "page_field": f"""SELECT page_id, CASE WHEN regexp_matches(html, '(?is)<title\\b[^>]*>(.*?)</title>')
  THEN {PLAIN.format("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)")} END AS title FROM pages""",
    "eval_leave_last_out": f"""WITH {TRAINED},
{ENDS.format('held')},
{nearest('SELECT basket_id AS query_id, item FROM numbered WHERE n >= 2 AND pos < n', 'history')},
{recommend(HISTORY_OWNED)},
tried AS (SELECT ends.basket_id, recs.item IS NOT NULL AS hit FROM ends
  LEFT JOIN near ON query_id = ends.basket_id
  LEFT JOIN recs ON u = near.basket_id AND recs.item = last_item AND rnk <= 10 WHERE n >= 2)
SELECT count(*) AS n, count(*) FILTER (hit) AS hits, round(avg(hit::INTEGER), 6) AS hit_rate FROM tried""",
    "eval_rank_positions": f"""WITH {TRAINED},
{ENDS.format('held')},
{nearest('SELECT basket_id AS query_id, item FROM numbered WHERE n >= 2 AND pos = 1', 'history')},
{recommend(HISTORY_OWNED)}
SELECT numbered.basket_id, numbered.item AS target, rnk - 1 AS pos FROM numbered
JOIN near ON query_id = numbered.basket_id JOIN recs ON u = near.basket_id AND recs.item = numbered.item
WHERE numbered.pos > 1""",
    "eval_rule_hit": f"""WITH branded AS (SELECT l_orderkey AS basket_id, p_brand AS item, l_linenumber, l_partkey, l_suppkey
  FROM lineitem JOIN part ON p_partkey = l_partkey),
{rules(BRAND_PAIRS)},
{ENDS.format('branded')},
edges AS (SELECT DISTINCT a, unnest(consequent) AS c FROM (SELECT unnest(antecedent) AS a, consequent FROM rules))
SELECT ends.basket_id, max(CASE WHEN edges.c IS NOT NULL THEN 1 ELSE 0 END) AS hit FROM ends
LEFT JOIN numbered ON numbered.basket_id = ends.basket_id AND pos > 1
LEFT JOIN edges ON edges.a = first_item AND edges.c = numbered.item GROUP BY 1""",
    "quota_admission": """WITH ledger AS (SELECT c_custkey, 50 + c_nationkey AS quota, c_nationkey // 2 AS done
  FROM customer WHERE c_mktsegment <> 'MACHINERY'),
placed AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS place FROM events)
SELECT event_id, CASE WHEN quota IS NULL THEN 401 WHEN place <= quota - done THEN 200 ELSE 403 END AS status
FROM placed LEFT JOIN ledger ON c_custkey = user_id""",
    "popular_list_roundtrip": f"WITH {LINES}, {TOP} SELECT item, rnk AS rank FROM top WHERE rnk <= 100",
    "stored_baskets_roundtrip": f"SELECT basket_id AS id, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM ({BRAND_PAIRS}) GROUP BY 1",
    "wide_baskets_csv": f"""WITH {LINES},
arrays AS (SELECT basket_id, list(item ORDER BY l_linenumber, l_partkey, l_suppkey) AS xs FROM lines GROUP BY 1),
width AS (SELECT max(len(xs)) AS w FROM arrays)
SELECT basket_id AS id, {text('xs || [-1 FOR i IN range(0, w - len(xs))]')} AS items FROM arrays, width""",
    "siblings_as_json": f"""WITH {CATALOGUE}, {BY_CODE}
SELECT id, string_agg(similar_id::VARCHAR, ',' ORDER BY similar_id) AS similar_ids FROM siblings WHERE place <= 5 GROUP BY 1""",
    "ratings_by_phone": f"""WITH {RATINGS},
asked AS (SELECT phone, tel_hashed FROM users ORDER BY md5('42|' || id), id LIMIT 20)
SELECT DISTINCT phone, goods_id, purchases FROM asked JOIN ratings USING (tel_hashed)""",
    "recommend_with_substitutes": f"""WITH RECURSIVE {LINES},
{HOLD_OUT},
stocked AS (SELECT * FROM history WHERE item % 4 <> 0),
{cosine('stocked', 'basket_id')},
owned AS (SELECT DISTINCT basket_id AS u, item AS i FROM stocked),
{recommend('owned')},
{ENDS.format('held')},
asked_first AS (SELECT basket_id AS query_id, item FROM numbered WHERE pos = 1),
{nearest('SELECT * FROM asked_first', 'stocked')},
answers AS (SELECT query_id, recs.* FROM near JOIN recs ON u = basket_id WHERE rnk <= 10),
{matches(80)}, {spread(1)}, {BY_CODE},
swaps AS (SELECT id, similar_id FROM chosen UNION ALL SELECT id, similar_id FROM siblings WHERE place = 1),
left_over AS (SELECT * FROM asked_first WHERE query_id NOT IN (SELECT query_id FROM answers)),
swapped AS (SELECT query_id, similar_id AS item FROM left_over JOIN swaps ON id = left_over.item),
{second(nearest('SELECT * FROM swapped', 'stocked'))},
qty AS (SELECT item, sum(quantity::BIGINT) AS qty FROM history GROUP BY 1),
{POPULAR}
SELECT query_id, item, round(score, 6) AS score, 'basket' AS source, rnk FROM answers
UNION ALL SELECT query_id, recs.item, round(score, 6), 'basket', rnk FROM near_second JOIN recs ON u = basket_id WHERE rnk <= 10
UNION ALL SELECT query_id, popular.item, 0.0, 'popular', place FROM left_over, popular
WHERE query_id NOT IN (SELECT query_id FROM near_second)""",
    "page_first_quoted": "SELECT page_id, nullif(regexp_extract(html, '''([^'']+)''', 1), '') AS quoted FROM pages",
    "page_panel_fields": "SELECT p_partkey AS page_id, '/maker/' || p_type AS link, p_name || ' & more' AS name FROM part",
    "page_panel_links": "SELECT p_partkey AS page_id, 0 AS pos, p_brand AS anchor_text FROM part",
    "sample_orders": "SELECT o_orderkey AS id FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 500",
    "ledger_after_batch": """WITH ledger AS (SELECT c_custkey, 50 + c_nationkey AS quota, c_nationkey // 2 AS done
  FROM customer WHERE c_mktsegment <> 'MACHINERY'),
asked AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1)
SELECT c_custkey::VARCHAR AS api_key, quota, done + greatest(0, least(coalesce(n, 0), quota - done)) AS requests_done
FROM ledger LEFT JOIN asked ON user_id = c_custkey""",
}

"""Reusable SQL fragments for the oracle queries (DuckDB dialect).

They restate, over the raw driver tables, what the library computes, so
the driver can check each Spark result against an independent engine.
"""

from vitrine.functions.cleaning import MISSING_TOKENS
from vitrine.functions.text import TEXT_DIM

TOKENS_SQL = ", ".join("'" + t.replace("'", "''") + "'" for t in MISSING_TOKENS)


def _txt(col: str) -> str:
    """Text field with missing tokens as NULL."""
    return f"CASE WHEN {col} IN ({TOKENS_SQL}) THEN NULL ELSE {col} END"


# A part's title, as ``sources.tables.part_title`` writes it.
TITLE = "concat_ws(' ', p_name, p_brand, p_size)"

# Cleaned catalogue from ``part`` (numeric price): keep complete rows with a
# usable price, then the lowest id per title.
PROD = f"""
prod AS (
  SELECT product_id, title, description, category, brand, price, rating, num_reviews FROM (
    SELECT *, row_number() OVER (PARTITION BY title ORDER BY product_id) AS rn_dedup FROM (
      SELECT printf('P%05d', p_partkey) AS product_id, {_txt(TITLE)} AS title, CAST(NULL AS VARCHAR) AS description,
             {_txt('p_type')} AS category, {_txt('p_brand')} AS brand, p_retailprice AS price,
             CAST(NULL AS DOUBLE) AS rating, CAST(NULL AS INTEGER) AS num_reviews
      FROM part)
    WHERE title IS NOT NULL AND category IS NOT NULL AND price IS NOT NULL
      AND NOT isnan(price) AND price > 0)
  WHERE rn_dedup = 1)"""

INTER = """
inter AS (
  SELECT printf('U%05d', o.o_custkey) AS user_id, printf('P%05d', l.l_partkey) AS product_id, 'purchase' AS interaction_type,
         o.o_orderdate AS ts
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey)"""

EVENTS = """
ev AS (SELECT event_id, printf('U%05d', user_id) AS user_id, event_type AS interaction_type, ts FROM events)"""

AFF = """
aff AS (
  SELECT i.user_id, p.category, count(*) AS n
  FROM inter i JOIN prod p ON i.product_id = p.product_id GROUP BY 1, 2)"""

TOP = """
top AS (
  SELECT * FROM (
    SELECT user_id, category, n,
           row_number() OVER (PARTITION BY user_id ORDER BY n DESC, category) AS rank
    FROM aff) WHERE rank <= 3)"""

PROF = """
prof AS (
  SELECT user_id, string_agg(category, ' ' ORDER BY rank) AS profile_text,
         list(category ORDER BY rank) AS categories
  FROM top GROUP BY user_id)"""

# Raw-text catalogue: part rendered as strings with the dirty values of
# ``sources.tables.raw_products``.
DIRTY_TITLES_SQL = "[NULL, '', 'NA', 'null', 'None']"
DIRTY_PRICES_SQL = "['', 'NA', 'x', 'NaN', '1d', ' 12 ', 'inf', '1e2', '1,000', '0x10', '1_0', '-5', '0']"

RAW = f"""
raw AS (
  SELECT CASE WHEN p_partkey % 50 = 9 THEN 'NA' ELSE printf('P%05d', p_partkey) END AS product_id,
         CASE WHEN p_partkey % 40 = 3
              THEN {DIRTY_TITLES_SQL}[CAST(floor(p_partkey / 40) AS BIGINT) % 5 + 1]
              ELSE {TITLE} END AS title,
         p_type AS category, p_brand AS brand,
         CASE WHEN p_partkey % 20 = 7
              THEN {DIRTY_PRICES_SQL}[CAST(floor(p_partkey / 20) AS BIGINT) % 13 + 1]
              ELSE CAST(p_retailprice AS VARCHAR) END AS price_text
  FROM (SELECT * FROM part UNION ALL SELECT * FROM part WHERE p_partkey % 100 = 0)),
typed AS (
  SELECT {_txt('product_id')} AS product_id,
         {_txt('title')} AS title, {_txt('category')} AS category, {_txt('brand')} AS brand,
         price_text,
         {_txt('price_text')} AS price_present,
         CASE WHEN regexp_matches(price_text, '^(\\s*[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?\\s*|[+-]?[iI][nN][fF]([iI][nN][iI][tT][yY])?)$')
              THEN TRY_CAST(trim(price_text) AS DOUBLE) END AS price_value
  FROM raw),
classified AS (
  SELECT *, CASE
      WHEN product_id IS NULL THEN 'missing_id'
      WHEN title IS NULL OR category IS NULL OR price_present IS NULL THEN 'missing_field'
      WHEN price_value IS NULL OR isnan(price_value) THEN 'bad_price'
      WHEN NOT (price_value > 0) THEN 'non_positive_price'
    END AS reason
  FROM typed)"""


def hashed_terms(name: str, source: str, key: str, text: str, dim: int = TEXT_DIM) -> str:
    """CTEs ``{name}_term(key, b, c)``: token counts per hash bucket, and
    ``{name}_norm(key, nrm)``: the text part's squared length."""
    return f"""
{name}_tok AS (
  SELECT {key} AS k, unnest(regexp_split_to_array(lower({text}), '[^a-z0-9]+')) AS w FROM {source}),
{name}_term AS (
  SELECT k, CAST(('0x' || substr(md5(w), 1, 8)) AS BIGINT) % {dim} AS b, CAST(count(*) AS DOUBLE) AS c
  FROM {name}_tok WHERE w <> '' GROUP BY 1, 2),
{name}_sq AS (SELECT k, sum(c * c) AS sq FROM {name}_term GROUP BY 1)"""


# Fixed value: the declared length of the stand-in image vectors (``sources.tables.IMAGE_DIM``).
IMAGE_DIM_SQL = "64"


def product_norms() -> str:
    """CTEs ``img(product_id, e)`` and ``pn(product_id, nrm)``: length of
    [text part, image part]; a missing or odd-sized image counts as zeros."""
    return f"""
img AS (
  SELECT printf('P%05d', vec_id) AS product_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = {IMAGE_DIM_SQL}
    AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pn AS (
  SELECT p.product_id,
         sqrt(coalesce(t.sq, 0) + coalesce(list_dot_product(i.e, i.e), 0)) AS nrm
  FROM prod p LEFT JOIN pt_sq t ON t.k = p.product_id LEFT JOIN img i ON i.product_id = p.product_id)"""


PRODUCT_TEXT = "lower(concat_ws(' ', coalesce(title, ''), coalesce(category, '')))"

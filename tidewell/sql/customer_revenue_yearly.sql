-- Net paid revenue of each customer and calendar year by channel: channels without sales are 0, a total of nulls only is null.
WITH sold AS (
  SELECT 'store' AS channel, ss_customer_sk AS buyer, ss_sold_date_sk AS day, ss_net_paid AS paid FROM raw.store_sales
  UNION ALL
  SELECT 'catalog', cs_bill_customer_sk, cs_sold_date_sk, cs_net_paid FROM raw.catalog_sales
  UNION ALL
  SELECT 'web', ws_bill_customer_sk, ws_sold_date_sk, ws_net_paid FROM raw.web_sales
)
SELECT
  buyer AS customer_sk,
  CAST(d_year AS BIGINT) AS calendar_year,
  CAST(coalesce(sum(CASE WHEN channel = 'store' THEN paid END), 0) AS DECIMAL(38, 2)) AS store_net_paid,
  CAST(coalesce(sum(CASE WHEN channel = 'catalog' THEN paid END), 0) AS DECIMAL(38, 2)) AS catalog_net_paid,
  CAST(coalesce(sum(CASE WHEN channel = 'web' THEN paid END), 0) AS DECIMAL(38, 2)) AS web_net_paid,
  CAST(sum(paid) AS DECIMAL(38, 2)) AS total_net_paid
FROM sold JOIN raw.date_dim ON day = d_date_sk
WHERE buyer IS NOT NULL
GROUP BY buyer, d_year

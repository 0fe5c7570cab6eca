"""The billing-table mapping of FIXTURES.md section 3, written in DuckDB SQL.

Independent of the Spark mapping in ``clinicledger/sources/fixture.py``: the
oracle queries are ``FIXTURE_CTE`` followed by the report text, over the
driver's pre-registered views ``customer orders lineitem part supplier
nation region``.
"""

FIXTURE_CTE = r"""
WITH
lines AS (
  SELECT l.*,
         l_orderkey * 2147483648 + row_number() OVER (
           PARTITION BY l_orderkey
           ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity) AS pid,
         CAST(l_extendedprice AS DECIMAL(10,2)) AS price,
         CAST(l_discount AS DECIMAL(4,2)) AS disc,
         (l_linenumber % 4 <> 0) AS ins_line
  FROM lineitem l
),
patient_profile AS (
  SELECT c_custkey AS patient_profile_id,
         CAST(c_custkey AS VARCHAR) AS patient_id,
         CASE c_custkey % 50 WHEN 7 THEN 'Mouse, M' WHEN 17 THEN 'TEST, A'
              WHEN 27 THEN 'Vistest' WHEN 37 THEN NULL ELSE c_name END AS last
  FROM customer
),
patient_visit AS (
  SELECT o_orderkey AS patient_visit_id,
         o_custkey AS patient_profile_id,
         CASE WHEN o_orderkey % 101 = 0 THEN NULL
              ELSE printf('%06d', o_orderkey)
                   || CASE WHEN o_orderkey IN (842, 2222, 45260) THEN 'A' ELSE '' END
         END AS ticket_number,
         o_orderkey % 10 AS doctor_id,
         1000000 + o_custkey % 25 AS facility_id,
         2000000 + o_custkey % 5 AS company_id,
         CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE o_orderkey % 25 END AS primary_insurance_carriers_id,
         o_orderdate AS visit,
         o_orderdate + INTERVAL 1 DAY AS entered,
         CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderdate + INTERVAL 3 DAY END AS first_filed_date
  FROM orders
),
doctor_facility AS (
  SELECT s_suppkey AS doctor_facility_id,
         CASE WHEN s_suppkey = 9 THEN 'PLB, Provider' ELSE s_name END AS list_name,
         'D' || CAST(s_suppkey AS VARCHAR) AS dot_id,
         CAST(NULL AS BIGINT) AS place_of_service_mid
  FROM supplier
  UNION ALL
  SELECT CAST(1000000 + n_nationkey AS BIGINT), n_name, CAST(NULL AS VARCHAR),
         CAST(300 + n_nationkey % 8 AS BIGINT)
  FROM nation
  UNION ALL
  SELECT CAST(2000000 + r_regionkey AS BIGINT), r_name, CAST(NULL AS VARCHAR), CAST(NULL AS BIGINT)
  FROM region
),
med_lists AS (
  SELECT CAST(med_lists_id AS BIGINT) AS med_lists_id, description, code, function_name
  FROM (VALUES
    (2495, 'Medicaid', NULL, NULL), (114348, 'Medicaid Managed Care', NULL, NULL),
    (2500, 'Self Pay', NULL, NULL), (2501, 'Sliding Fee', NULL, NULL),
    (2497, 'Medicare', NULL, NULL), (114349, 'Medicare Advantage', NULL, NULL),
    (146, 'Medicare Part B', NULL, NULL), (9001, 'Commercial', NULL, NULL),
    (2400, 'Doctors', NULL, NULL), (2401, 'BHC', NULL, NULL), (2402, 'Dentists', NULL, NULL),
    (2403, 'Hygienists', NULL, NULL), (2404, 'Nurses', NULL, NULL),
    (2460, 'Prenatal Provider', NULL, NULL),
    (300, 'Office', '11', NULL), (301, 'Homeless Shelter', '04', NULL),
    (302, 'Federally Qualified Health Center', '50', NULL), (303, 'Inpatient Hospital', '21', NULL),
    (304, 'Outpatient Hospital', '22', NULL), (305, 'Home', '12', NULL),
    (306, 'Other Place of Service', '99', NULL),
    (400, 'HCPC - MED', NULL, NULL), (401, 'HCPC - DEN', NULL, NULL), (402, 'HCPC - BH', NULL, NULL),
    (403, 'HCPC - BH visit', NULL, NULL), (404, 'HCPC - MISC', NULL, NULL), (405, 'CPT - LAB', NULL, NULL),
    (500, 'Medical', NULL, NULL), (501, 'Dental', NULL, NULL), (502, 'Behavioral Health', NULL, NULL),
    (503, 'Administration', NULL, NULL),
    (600, 'Contractual Adjustment', NULL, 'Y'), (601, 'Write Off', NULL, 'N'),
    (602, 'Other Adjustment', NULL, NULL)
  ) AS v(med_lists_id, description, code, function_name)
),
insurance_carriers AS (
  SELECT CAST(n_nationkey AS BIGINT) AS insurance_carriers_id,
         CASE WHEN n_nationkey = 13 THEN NULL ELSE 'Carrier ' || n_name END AS list_name,
         CAST(CASE n_nationkey % 10 WHEN 0 THEN 2495 WHEN 1 THEN 114348 WHEN 2 THEN 2500
              WHEN 3 THEN 2501 WHEN 4 THEN 2497 WHEN 5 THEN 114349 WHEN 6 THEN 146
              WHEN 7 THEN 9001 WHEN 8 THEN 9002 ELSE NULL END AS BIGINT) AS policy_type_mid
  FROM nation
),
procedures AS (
  SELECT p_partkey AS procedures_id,
         CAST(500 + p_size % 5 AS BIGINT) AS department_mid,
         CAST(400 + p_size % 7 AS BIGINT) AS cpt_procedure_code_qualifier_mid
  FROM part
),
batch AS (
  SELECT p_partkey AS batch_id FROM part WHERE p_partkey < 49
),
patient_visit_procs AS (
  SELECT pid AS patient_visit_procs_id,
         l_orderkey AS patient_visit_id,
         CASE WHEN l_partkey % 53 = 0 THEN NULL ELSE l_partkey END AS procedures_id,
         l_partkey % 50 AS batch_id,
         CASE l_partkey % 16 WHEN 0 THEN '90832UL' WHEN 1 THEN '96150' WHEN 2 THEN '98966BH'
              WHEN 3 THEN NULL ELSE '992' || printf('%02d', l_partkey % 16) END AS code,
         CASE l_partkey % 12 WHEN 0 THEN '520' WHEN 1 THEN 'T1015' WHEN 2 THEN '900'
              WHEN 3 THEN 'D2999' WHEN 4 THEN NULL ELSE '99213' END AS cpt_code,
         CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN -l_quantity ELSE l_quantity END AS units,
         l_shipdate + to_hours(3 * l_linenumber) AS date_of_service_from,
         l_shipdate + to_hours(3 * l_linenumber) + INTERVAL 5 DAY AS date_of_entry,
         price AS total_allowed
  FROM lines
),
patient_visit_procs_agg AS (
  SELECT pid AS patient_visit_procs_id,
         l_orderkey AS patient_visit_id,
         CAST(CASE WHEN disc = 0 OR NOT ins_line THEN 0 ELSE price END AS DECIMAL(10,2)) AS ins_allocation,
         CAST(CASE WHEN disc = 0 OR ins_line THEN 0 ELSE price END AS DECIMAL(10,2)) AS pat_allocation,
         CAST(CASE WHEN ins_line THEN CAST(price * disc AS DECIMAL(10,2)) ELSE 0 END AS DECIMAL(10,2)) AS ins_adjustment,
         CAST(CASE WHEN ins_line THEN 0 ELSE CAST(price * disc AS DECIMAL(10,2)) END AS DECIMAL(10,2)) AS pat_adjustment,
         CAST(CASE WHEN ins_line THEN price ELSE 0 END AS DECIMAL(10,2)) AS orig_ins_allocation,
         CAST(CASE WHEN ins_line THEN 0 ELSE price END AS DECIMAL(10,2)) AS orig_pat_allocation
  FROM lines
),
patient_visit_agg AS (
  SELECT o_orderkey AS patient_visit_id, o_custkey AS patient_profile_id,
         CAST(o_totalprice AS DECIMAL(10,2)) AS ins_payment
  FROM orders
),
patient_visit_resource AS (
  SELECT o_orderkey * 10 + 1 AS patient_visit_resource_id, o_orderkey AS patient_visit_id,
         o_orderkey % 10 AS resource_id
  FROM orders WHERE o_orderkey % 13 <> 0
  UNION ALL
  SELECT o_orderkey * 10 + 2, o_orderkey, (o_orderkey + 3) % 10
  FROM orders WHERE o_orderkey % 5 = 0
),
resource_type_assignments AS (
  SELECT s_suppkey AS resource_id, CAST(2400 + s_suppkey % 5 AS BIGINT) AS resource_type_id FROM supplier
  UNION ALL
  SELECT s_suppkey, CAST(2460 AS BIGINT) FROM supplier WHERE s_suppkey % 4 = 0
  UNION ALL
  SELECT s_suppkey, CAST(2401 AS BIGINT) FROM supplier WHERE s_suppkey % 7 = 0
),
order_sources AS (
  SELECT o.*, s FROM orders o, (VALUES (0), (1)) AS src(s)
),
payment_method AS (
  SELECT o_orderkey * 2 + s AS payment_method_id,
         o_orderkey % 50 AS batch_id,
         CAST(s + 1 AS INTEGER) AS source,
         'CK' || CAST(o_orderkey AS VARCHAR) AS check_card_number,
         o_orderdate + INTERVAL 30 DAY AS check_date,
         CASE WHEN s = 0 THEN 'Patient' ELSE 'Insurance' END AS payer_type,
         o_orderdate + INTERVAL 35 DAY AS date_of_entry
  FROM order_sources
),
visit_transactions AS (
  SELECT o_orderkey * 2 + s AS visit_transactions_id, o_orderkey AS patient_visit_id,
         o_orderkey * 2 + s AS payment_method_id
  FROM order_sources
),
transactions AS (
  SELECT (o_orderkey * 2 + s) * 3 + a AS transactions_id,
         o_orderkey * 2 + s AS visit_transactions_id,
         CASE a WHEN 0 THEN 'P' WHEN 1 THEN 'A' ELSE 'T' END AS action,
         CASE WHEN a = 1 THEN 600 + o_orderkey % 4 ELSE NULL END AS action_type_mid
  FROM order_sources, (VALUES (0), (1), (2)) AS act(a)
),
transaction_distributions AS (
  SELECT (l_orderkey * 2 + CASE WHEN a = 1 AND pid % 3 = 0 THEN 1 - src ELSE src END) * 3 + a
           AS transactions_id,
         pid AS patient_visit_procs_id,
         CAST(CASE WHEN l_tax = 0 THEN 0
                   WHEN a = 0 THEN CAST(price * (1 - disc) AS DECIMAL(10,2))
                   WHEN a = 1 THEN CAST(price * disc AS DECIMAL(10,2))
                   ELSE 1.00 END AS DECIMAL(10,2)) AS amount
  FROM (SELECT *, CASE WHEN ins_line THEN 1 ELSE 0 END AS src FROM lines) x,
       (VALUES (0), (1), (2)) AS act(a)
)
"""

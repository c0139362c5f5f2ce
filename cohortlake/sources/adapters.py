"""Views that give the driver's tables the shape of the trial data model.

Each view is one SELECT in the SQL both engines share, so a query and its
check read the same rows. In Spark the source tables are DataFrames bound by
name, which keeps column pruning and filter pushdown down to the Parquet scan.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
               "documents", "conversations"]

NCT = "concat('NCT', lpad(CAST({key} AS STRING), CAST(greatest(8, length(CAST({key} AS STRING))) AS INT), '0'))"

VIEWS = {
    "trials_v": f"""
SELECT {NCT.format(key='o_orderkey')} AS trial_id,
       concat('Study of Drug-', CAST(o_orderkey % 97 AS STRING), ' in ', c_mktsegment) AS trial_name,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Phase I' WHEN '2-HIGH' THEN 'Phase II'
            WHEN '3-MEDIUM' THEN 'Phase III' WHEN '4-NOT SPECIFIED' THEN 'Phase IV' END AS phase,
       CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'Oncology' WHEN 'BUILDING' THEN 'Cardiology'
            WHEN 'FURNITURE' THEN 'Neurology' WHEN 'HOUSEHOLD' THEN 'Immunology'
            ELSE 'Endocrinology' END AS therapeutic_area,
       concat('Drug-', CAST(o_orderkey % 97 AS STRING)) AS drug_name,
       concat('Condition ', CAST(o_orderkey % 31 AS STRING)) AS indication,
       CAST(10 + o_orderkey % 1200 AS INT) AS enrollment,
       CAST(30 + o_orderkey % 1100 AS INT) AS duration_days,
       CASE o_orderstatus WHEN 'F' THEN 'Completed' WHEN 'O' THEN 'Active' ELSE 'Terminated' END AS status,
       o_orderstatus = 'F' AS success,
       CAST(o_custkey % 36 AS DOUBLE) / 100 AS dropout_rate,
       CAST(o_custkey % 60 AS INT) AS adverse_events,
       o_totalprice AS cost_usd,
       CAST(18 + o_orderkey % 30 AS INT) AS min_age,
       CAST(50 + o_orderkey % 46 AS INT) AS max_age,
       CAST(o_custkey % 101 AS DOUBLE) / 100 AS expected_success_rate,
       CAST(o_orderdate AS DATE) AS start_date
FROM {{orders}} JOIN {{customer}} ON o_custkey = c_custkey""",
    "drugs_v": """
SELECT concat('DRUG-', CAST(p_partkey AS STRING)) AS drug_id,
       concat('Drug-', CAST(p_partkey AS STRING)) AS drug_name,
       p_type AS mechanism, p_retailprice AS molecular_weight,
       CASE WHEN p_size % 10 = 0 THEN CAST('NaN' AS DOUBLE)
            WHEN p_size % 10 = 1 THEN CAST('Infinity' AS DOUBLE)
            WHEN p_size % 10 = 2 THEN CAST('-Infinity' AS DOUBLE)
            ELSE CAST(p_size AS DOUBLE) / 100 END AS bioavailability,
       p_brand AS manufacturer
FROM {part}""",
    "results_v": f"""
SELECT concat('sim_', CAST(o_orderkey AS STRING)) AS simulation_id,
       CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE {NCT.format(key='o_orderkey')} END AS trial_id,
       CAST(o_orderkey % 150 AS STRING) AS user_id,
       CAST(o_orderkey % 500 AS INT) AS patients_enrolled,
       CASE WHEN o_orderkey % 7 = 0 THEN NULL
            ELSE CAST((o_orderkey % 500) - (o_orderkey % 500) % 9 AS INT) END AS patients_completed,
       CAST(o_custkey % 36 AS DOUBLE) / 100 AS dropout_rate,
       CAST(30 + o_orderkey % 1100 AS INT) AS actual_duration_days,
       o_totalprice AS estimated_cost,
       CASE WHEN o_orderkey % 11 = 0 THEN NULL
            ELSE CAST(o_orderkey % 101 AS DOUBLE) / 100 END AS success_probability,
       concat('(0.', CAST(o_orderkey % 5 AS STRING), ', 0.', CAST(5 + o_orderkey % 5 AS STRING), ')')
           AS confidence_interval,
       CAST(o_orderdate AS TIMESTAMP) AS created_at
FROM {{orders}}""",
    "patients_v": f"""
SELECT {NCT.format(key='l_orderkey')} AS trial_id,
       CAST(18 + l_partkey % 68 AS INT) AS age,
       CAST(l_suppkey % 4 AS INT) AS comorbidity_count,
       l_returnflag = 'R' AS dropped_out,
       CASE l_linestatus WHEN 'O' THEN 'Placebo' ELSE 'Treatment' END AS treatment_arm,
       CAST(l_shipdate AS DATE) AS enrollment_date,
       CAST(30 + l_partkey % 300 AS INT) AS dropout_day
FROM {{lineitem}}""",
    "adverse_events_v": f"""
SELECT {NCT.format(key='l_orderkey')} AS trial_id,
       CASE WHEN l_partkey % 100 < 60 THEN 'Mild' WHEN l_partkey % 100 < 90 THEN 'Moderate'
            WHEN l_partkey % 100 < 99 THEN 'Severe' ELSE 'Life-threatening' END AS severity
FROM {{lineitem}} WHERE l_returnflag = 'A'""",
    "chat_v": """
SELECT event_id AS chat_id, CAST(user_id AS STRING) AS user_id, CAST(ts AS TIMESTAMP) AS timestamp,
       CASE event_type
         WHEN 'signup' THEN concat('Set it to ', CAST(event_id % 500 AS STRING))
         WHEN 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'YES' WHEN 1 THEN 'confirm' ELSE 'হ্যাঁ' END
         WHEN 'error' THEN CASE event_id % 2 WHEN 0 THEN 'No' ELSE 'नहीं' END
         WHEN 'click' THEN
           CASE WHEN event_id % 7 = 0 THEN concat('please change simulation sim_', CAST(event_id AS STRING), ' phase: 2')
                ELSE concat('Update simulation sim_',
                CAST(CASE WHEN event_id % 2 = 0 THEN event_id - event_id % 150 + user_id ELSE event_id END AS STRING),
                ' dropout rate to 0.', CAST(event_id % 9 + 1 AS STRING)) END
         ELSE CASE event_id % 4 WHEN 0 THEN 'Show my simulations'
                                WHEN 1 THEN 'Translate this to Hindi'
                                WHEN 2 THEN concat('How is SIM_', CAST(event_id - event_id % 150 + user_id AS STRING), ' doing?')
                                ELSE 'आंकड़े दिखाओ' END END AS message,
       CASE WHEN event_id % 41 = 0 THEN 'bn' WHEN event_id % 97 = 0 THEN 'hi' END AS forced_language
FROM {events}""",
    "changes_v": """
SELECT event_id AS change_id, concat('sim_', CAST(event_id % 20000 - event_id % 3 AS STRING)) AS simulation_id,
       CASE event_type WHEN 'click' THEN 'patients_enrolled' WHEN 'purchase' THEN 'dropout_rate'
            WHEN 'error' THEN 'sponsor' WHEN 'signup' THEN 'estimated_cost' ELSE 'trial_id' END AS field,
       CASE WHEN event_id % 13 = 0 THEN '1.2.3' WHEN event_type = 'click' THEN CAST(event_id % 500 AS STRING)
            WHEN event_type = 'view' THEN concat('NCT', CAST(event_id AS STRING))
            ELSE concat('0.', CAST(event_id % 9 + 1 AS STRING)) END AS value,
       CAST(ts AS TIMESTAMP) AS changed_at
FROM {events}""",
    "logins_v": """
SELECT event_id AS login_id, CAST(ts AS TIMESTAMP) AS timestamp, CAST(user_id AS STRING) AS user_id,
       CASE WHEN event_id % 5 = 0 THEN concat('10.0.0.', CAST(event_id % 250 AS STRING), ' , 172.16.0.1') END AS x_forwarded_for,
       CASE WHEN event_id % 5 = 1 THEN concat('192.168.1.', CAST(event_id % 250 AS STRING)) END AS x_real_ip,
       CASE WHEN event_id % 5 <> 4 THEN concat('203.0.113.', CAST(user_id % 250 AS STRING)) END AS peer,
       CASE WHEN event_id % 4 <> 0 THEN CAST(event_id % 180 - 90 AS DOUBLE) + 5e-1 END AS latitude,
       CASE WHEN event_id % 4 <> 0 THEN CAST(user_id % 300 - 150 AS DOUBLE) + 25e-2 END AS longitude,
       CASE WHEN event_id % 3 <> 0 THEN value END AS accuracy
FROM {events}""",
    "address_places_v": """
SELECT concat('203.0.113.', CAST(c_custkey % 250 AS STRING)) AS ip_address,
       max(n_name) AS country, max(r_name) AS region,
       CASE WHEN c_custkey % 250 % 4 = 0 THEN NULL ELSE max(c_mktsegment) END AS city,
       CAST(c_custkey % 250 % 90 AS DOUBLE) AS latitude, CAST(c_custkey % 250 % 180 AS DOUBLE) AS longitude,
       max(c_mktsegment) AS isp, 'UTC' AS timezone
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY c_custkey % 250""",
    # blocks inside each other, the outermost holding every address
    "address_blocks_v": """
SELECT network, country, region, city, latitude, longitude, isp, 'UTC' AS timezone FROM (
  SELECT concat('203.0.113.', CAST(c_custkey % 16 * 16 AS STRING), '/28') AS network, max(n_name) AS country,
         max(r_name) AS region, max(c_mktsegment) AS city, 1e0 AS latitude, 2e0 AS longitude, 'small' AS isp
  FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
  WHERE c_custkey % 16 % 3 <> 1 GROUP BY c_custkey % 16
  UNION ALL
  SELECT concat('203.0.113.', CAST(n_nationkey % 4 * 64 AS STRING), '/26'), max(n_name), max(r_name), NULL, 3e0, 4e0, 'medium'
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 4 <> 2 GROUP BY n_nationkey % 4
  UNION ALL
  SELECT concat('10.0.0.', CAST(n_nationkey % 8 * 32 AS STRING), '/27'), min(n_name), min(r_name), 'Inside', 5e0, 6e0, 'inner'
  FROM {nation} JOIN {region} ON n_regionkey = r_regionkey WHERE n_nationkey % 8 < 5 GROUP BY n_nationkey % 8
  UNION ALL
  SELECT CASE r_regionkey WHEN 0 THEN '10.0.0.0/8' WHEN 1 THEN '0.0.0.0/0' WHEN 2 THEN '203.0.113.77/32'
              ELSE concat('198.51.100.', CAST(r_regionkey AS STRING), '/31') END, r_name, 'Wide', NULL, 7e0, 8e0, 'large'
  FROM {region}) b""",
    "gps_places_v": """
SELECT CAST(c_custkey % 180 - 90 AS DOUBLE) + 5e-1 AS latitude,
       CAST(c_custkey % 300 - 150 AS DOUBLE) + 25e-2 AS longitude,
       max(n_name) AS country,
       CASE WHEN c_custkey % 900 % 5 = 0 THEN NULL ELSE concat('State ', max(n_name)) END AS state,
       max(r_name) AS region,
       CASE WHEN c_custkey % 900 % 4 = 0 THEN concat('City ', max(n_name)) END AS city,
       CASE WHEN c_custkey % 900 % 4 = 1 THEN concat('Town ', max(n_name)) END AS town,
       CASE WHEN c_custkey % 900 % 4 = 2 THEN concat('Village ', max(n_name)) END AS village
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
GROUP BY c_custkey % 180, c_custkey % 300, c_custkey % 900""",
    "users_v": """
SELECT CAST(c_custkey + 1 AS INT) AS index, c_mktsegment AS first_name, 'User' AS last_name,
       c_name AS username, concat(lower(c_name), '@example.com') AS email,
       c_nationkey AS nation FROM {customer}""",
    "registrations_v": """
SELECT o_orderkey AS request_id, CASE WHEN o_orderkey % 17 = 0 THEN '' ELSE 'New' END AS first_name,
       'Person' AS last_name,
       CASE WHEN o_orderkey % 3 = 0 THEN concat('CUSTOMER#', lpad(CAST(o_custkey AS STRING), 9, '0'))
            ELSE concat('User', CAST(o_orderkey - o_orderkey % 4 AS STRING)) END AS username,
       CASE WHEN o_orderkey % 5 = 0 THEN concat('Customer#', lpad(CAST(o_custkey AS STRING), 9, '0'), '@EXAMPLE.com')
            ELSE concat('user', CAST(o_orderkey AS STRING), '@new.org') END AS email,
       concat('pw', CAST(o_orderkey AS STRING)) AS password
FROM {orders}""",
    "answers_v": """
SELECT o_orderkey AS answer_id,
       concat(CASE WHEN o_orderkey % 6 = 0 THEN 'No tag here. ' ELSE concat('SUCCESS_PROBABILITY: ', CAST(o_orderkey % 140 AS STRING), '%
') END,
              CASE WHEN o_orderkey % 7 = 0 THEN 'CONFIDENCE: high
' WHEN o_orderkey % 7 = 1 THEN '' ELSE concat('CONFIDENCE: ', CAST(o_orderkey % 100 AS STRING), '.5%
') END,
              CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE concat('RISK_FACTORS: ', o_orderstatus, ',  , ', o_orderpriority,
                   ', third , fourth,fifth,', CAST(o_custkey AS STRING), ', last
') END,
              CASE WHEN o_orderkey % 9 = 0 THEN '' ELSE concat('EXPLANATION:  based on ', o_orderpriority, ' data
over two lines ') END) AS answer
FROM {orders}""",
    "designs_v": """
SELECT o_orderkey AS design_id,
       CASE WHEN o_orderkey % 19 = 0 THEN 'T1' WHEN o_orderkey % 23 = 0 THEN '   '
            ELSE concat('Trial ', CAST(o_orderkey AS STRING)) END AS trial_name,
       CASE WHEN o_orderpriority = '5-LOW' THEN 'Phase V' WHEN o_orderpriority = '1-URGENT' THEN 'Phase I'
            ELSE 'Phase II' END AS phase,
       'Oncology' AS therapeutic_area,
       CASE WHEN o_orderkey % 29 = 0 THEN NULL ELSE 'DrugX' END AS drug_name, 'Some condition' AS indication,
       CAST(o_orderkey % 12000 AS INT) AS target_enrollment,
       CAST(15 + o_orderkey % 10 AS INT) AS min_age, CAST(20 + o_orderkey % 90 AS INT) AS max_age,
       CAST(o_orderkey % 3700 AS INT) AS duration_days,
       CASE WHEN o_orderkey % 31 = 0 THEN '' ELSE 'Survival' END AS primary_endpoint,
       CAST(o_orderkey % 3 AS INT) AS arm_count,
       CAST(o_custkey % 120 AS DOUBLE) / 100 AS expected_dropout_rate,
       CAST(o_custkey % 110 - 5 AS DOUBLE) / 100 AS expected_success_rate
FROM {orders}""",
    "patient_forms_v": """
SELECT l_orderkey * 8 + l_linenumber AS form_id, CAST(10 + l_partkey % 100 AS INT) AS age,
       CASE l_suppkey % 5 WHEN 0 THEN 'Female' WHEN 1 THEN 'Other' WHEN 2 THEN 'unknown' WHEN 3 THEN NULL ELSE 'Male' END AS gender,
       CAST(20 + l_partkey % 300 AS DOUBLE) AS weight_kg, CAST(90 + l_suppkey % 170 AS DOUBLE) AS height_cm
FROM {lineitem}""",
    "requests_v": """
SELECT event_id AS request_id, CASE WHEN event_id % 11 = 0 THEN 'short' ELSE concat('Tell me about ', event_type) END AS query,
       CASE event_id % 6 WHEN 0 THEN 'research' WHEN 1 THEN 'prediction' WHEN 2 THEN 'optimization' WHEN 3 THEN 'report'
                         WHEN 4 THEN 'poetry' END AS agent_type,
       CAST(event_id % 120 AS INT) AS num_simulations
FROM {events}""",
    "forms_v": """
SELECT o_orderkey AS form_id, CAST(o_orderkey % 500 AS STRING) AS patients_enrolled,
       CASE WHEN o_orderkey % 9 = 0 THEN 'n/a' ELSE CAST(o_custkey % 100 AS STRING) END AS dropout_percent,
       CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'false' END AS primary_endpoint_met,
       CASE WHEN o_orderkey % 8 = 0 THEN '' ELSE CAST(o_totalprice AS STRING) END AS estimated_cost
FROM {orders}""",
    "contexts_v": """
SELECT event_id, CASE WHEN event_type = 'error' THEN concat('not json ', props) ELSE props END AS context
FROM {events}""",
    "questions_v": """
SELECT o_orderkey AS question_id,
       concat('What about ', CASE o_orderstatus WHEN 'F' THEN 'Phase II trials' WHEN 'O' THEN 'ONCOLOGY work'
                                  ELSE 'success factors' END,
              CASE WHEN o_orderkey % 2 = 0 THEN ' and what do you recommend?' ELSE '?' END) AS query
FROM {orders}""",
    "claims_v": """
SELECT event_id AS claim_id, concat('sim_', CAST(event_id AS STRING)) AS simulation_id,
       CAST(CASE WHEN event_id % 3 = 0 THEN user_id ELSE event_id % 150 END AS STRING) AS user_id
FROM {events}""",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the adapter views as a DataFrame."""
    text = VIEWS[name]
    used = {t: table(spark, sf_dir, t) for t in BASE_TABLES if f"{{{t}}}" in text}
    return spark.sql(text, **used)


def loader(spark: SparkSession, sf_dir: str):
    """``view`` with session and folder filled in."""
    return partial(view, spark, sf_dir)


def view_sql(name: str) -> str:
    """The view's SELECT over plainly named tables."""
    text = VIEWS[name]
    for t in BASE_TABLES:
        text = text.replace(f"{{{t}}}", t)
    return text


def with_views(body: str, *names: str) -> str:
    """``body`` preceded by the named views as common table expressions."""
    return "WITH " + ",\n".join(f"{n} AS ({view_sql(n)})" for n in names) + f"\n{body}"

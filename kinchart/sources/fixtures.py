"""Health-record views over the driver's TPC-H-like tables.

One text per view serves both engines, so an oracle query starts from exactly the rows the Spark
query starts from.  ``{customer}`` and the like are the inputs; ``<add d | n>`` adds n days to d and
``<each rows | name(columns)>`` repeats every row for each entry of a short fixed list.
"""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinchart.session import configure

AS_OF = "2001-08-02"

_RELATIONS = (
    "(values (0, 'father'), (1, 'mother'), (2, 'brother'), (3, 'sister'), (4, 'son'), (5, 'daughter'), "
    "(6, 'paternal_grandfather'), (7, 'paternal_grandmother'), (8, 'maternal_grandfather'), "
    "(9, 'maternal_grandmother'), (10, 'husband'), (11, 'wife'), (12, 'partner'), (13, 'uncle'), "
    "(14, 'aunt'), (15, 'nephew'), (16, 'niece'), (17, 'cousin'), (18, 'other')) as rd(ri, relationship)"
)
_DISEASES = (
    "(values (0, 'diabetes'), (1, 'hypertension'), (2, 'hypothyroidism'), (3, 'coronary artery disease'), "
    "(4, 'depression'), (5, 'asthma'), (6, 'osteoporosis'), (7, 'breast cancer'), (8, 'gout'), "
    "(9, 'migraine')) as dd(di, disease)"
)
_MEDICINES = (
    "(values (0, 'metformin'), (1, 'amlodipine'), (2, 'levothyroxine'), (3, 'atorvastatin'), "
    "(4, 'aspirin'), (5, 'glycomet'), (6, 'thyronorm'), (7, 'losartan'), (8, 'paracetamol'), "
    "(9, 'insulin glargine')) as md(mi, medicine)"
)
_LABS = (
    "(values (0, 'FBS'), (1, 'HbA1c'), (2, 'TSH'), (3, 'systolic'), (4, 'diastolic'), (5, 'cholesterol'), "
    "(6, 'LDL'), (7, 'HDL'), (8, 'triglycerides'), (9, 'creatinine')) as lb(li, lab)"
)

VIEWS = {
    "fx_users": """
        select c_custkey as id, c_name as full_name,
          <add date '1940-01-01' | (c_custkey * 37) % 25000> as date_of_birth,
          case c_custkey % 3 when 0 then 'male' when 1 then 'female' end as gender,
          case c_custkey % 10 when 3 then 'doctor' else 'patient' end as role
        from {customer}""",
    "fx_members": f"""
        select o_orderkey as id, o_custkey as user_id, concat('Member#', cast(o_orderkey as string)) as name,
          relationship, o_orderstatus = 'F' as is_deceased,
          case when o_orderkey % 2 = 0 then (o_orderkey * 7919) % (select max(c_custkey) + 1 from {{customer}}) end as related_user_id,
          o_orderdate as created_at
        from {{orders}} join {_RELATIONS} on o_orderkey % 19 = ri where o_orderkey % 3 = 0""",
    "fx_records": """
        select o_orderkey as id, o_custkey as owner_id,
          case when o_orderkey % 3 = 0 then o_orderkey end as family_member_id,
          case o_orderkey % 4 when 0 then 'prescription' when 1 then 'lab_report'
            when 2 then 'diagnosis' else 'imaging' end as record_type,
          case when o_orderkey % 11 <> 0 then cast(o_orderdate as date) end as record_date,
          case o_orderkey % 10 when 0 then 'failed' when 1 then 'pending' else 'done' end as extraction_status,
          cast(o_orderkey % 101 as double) / 100 as confidence_score,
          o_orderkey % 5 = 0 as is_verified_by_user, o_orderdate as created_at
        from {orders}""",
    "fx_lines": """
        select l_orderkey as record_id, l_partkey as pk, l_suppkey as sk, cast(l_quantity as int) as qty,
          cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity) as int) as n
        from {lineitem}""",
    "fx_entities": f"""
        select record_id * 100 + n as id, record_id,
          case when n % 3 = 1 then 'disease' when n % 3 = 2 then 'medicine' else 'lab_value' end as entity_type,
          case when n % 3 = 1 then disease when n % 3 = 2 then medicine else lab end as entity_value,
          cast(50 + pk % 50 as double) / 100 as confidence, pk % 13 = 0 as user_corrected,
          case when pk % 13 = 0 then concat(disease, ' (corrected)') end as corrected_value,
          case when n % 3 = 0 then cast(qty as double) * 4 end as lab_numeric_value
        from {{fx_lines}} join {_DISEASES} on pk % 10 = di join {_MEDICINES} on sk % 10 = mi
          join {_LABS} on (pk + sk) % 10 = li""",
    "fx_predictions": """
        select c_custkey * 10 + pi as id, c_custkey as user_id, disease_name, icd10_code,
          cast((c_custkey * 7919 + pi * 104729) % 1000 as double) / 1000 as probability,
          case when (c_custkey * 7919 + pi * 104729) % 1000 >= 600 then 'high'
            when (c_custkey * 7919 + pi * 104729) % 1000 >= 300 then 'moderate' else 'low' end as risk_level,
          (c_custkey + pi) % 7 <> 0 as is_active
        from {customer} <each (0, 'Type 2 Diabetes', 'E11'), (1, 'Hypertension', 'I10'),
          (2, 'Thyroid Disorder', 'E03.9'), (3, 'Cardiovascular Disease', 'I25.1')
          | pd(pi, disease_name, icd10_code)>""",
    # four grants a patient, eighty patients a doctor, whatever the number of customers
    "fx_access": """
        select c_custkey * 4 + ki as id, c_custkey as patient_id, cast((c_custkey - c_custkey % 20) / 20 as bigint) + off as doctor_id,
          'read' as access_level,
          case when c_custkey % 3 <> 0
            then <add date '2001-01-01' | (c_custkey * 13 + ki * 97) % 400> end as expires_at,
          (c_custkey + ki) % 4 <> 0 as is_active
        from {customer} <each (0, 0), (1, 7), (2, 14), (3, 21) | dk(ki, off)>""",
    "fx_invites": """
        select id, user_id as inviter_id, id as family_member_id, relationship,
          concat('tok', cast(id as string)) as token,
          case id % 4 when 0 then 'accepted' when 1 then 'declined' else 'pending' end as status,
          created_at, created_at + interval '72' hour as expires_at
        from {fx_members}""",
    "fx_notes": f"""
        select record_id * 100 + n as doc_id, record_id, concat('Dr. Asha Rao, City Hospital. Dx: ', disease, '. Tab ', medicine,
          ' ', cast(qty as string), 'mg BD for ', cast(1 + pk % 14 as string), ' days. BP: ',
          cast(100 + pk % 80 as string), '/', cast(60 + sk % 40 as string), ' mmHg. FBS: ',
          cast(70 + pk % 120 as string), ' mg/dL. Date ', cast(1 + pk % 28 as string), '/',
          cast(1 + sk % 12 as string), '/2025. Review after ', cast(1 + sk % 8 as string), ' weeks') as text
        from {{fx_lines}} join {_DISEASES} on pk % 10 = di join {_MEDICINES} on sk % 10 = mi""",
    "fx_words": """
        select record_id as doc_id, cast(1 as int) as page, n as word_no, e.engine,
          concat('w', cast(n as string)) as text, cast(n * 60 + off as double) as x_min,
          cast((record_id % 5) * 40 + off as double) as y_min, cast(n * 60 + 50 + off as double) as x_max,
          cast((record_id % 5) * 40 + 18 + off as double) as y_max,
          cast((pk * e.mul) % 101 as double) / 100 as confidence
        from {fx_lines} <each ('tesseract', 0, 7), ('easyocr', 6, 11) | e(engine, off, mul)>
        where not (e.engine = 'easyocr' and n % 4 = 0)""",
}

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()

_ADD = re.compile(r"<add ([^|>]+) \| ([^>]+)>")
_EACH = re.compile(r"<each ([^|>]+)\| (\w+)\(([^)]+)\)>")


def view_text(name: str, dialect: str) -> str:
    """Text of a view with its inputs still as ``{input}`` place holders."""
    form = r"date_add(\1, cast(\2 as int))" if dialect == "spark" else r"(\1 + cast(\2 as integer))"
    text = _ADD.sub(form, VIEWS[name]).strip()
    if dialect == "spark":  # every row once per entry of a fixed list: a generator, not a join
        return _EACH.sub(lambda m: f"lateral view inline(array({m[1].strip()})) {m[2]} as {m[3]}", text)
    return _EACH.sub(r"cross join (values \1) as \2(\3)", text)


def inputs(text: str) -> list[str]:
    return sorted(set(re.findall(r"\{(\w+)\}", text)))


class Tables:
    """Base tables and views of one data folder, made on first use."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = configure(spark)
        self.folder = folder
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            if name in BASE_TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            elif name == "lines":
                self._made[name] = self._lines()
            elif f"fx_{name}" in VIEWS:
                text = view_text(f"fx_{name}", "spark")
                sources = {i: getattr(self, i.removeprefix("fx_")) for i in inputs(text)}
                made = self.spark.sql(text, **sources)
                self._made[name] = self.spread(made, self.lineitem) if name == "notes" else made
            else:
                raise AttributeError(name)
        return self._made[name]

    def _lines(self) -> DataFrame:
        """The rows of ``fx_lines``; numbered as they are read, so that no column is shuffled twice under two names."""
        order = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
        number = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*order))
        return self.lineitem.select("l_orderkey", *order).withColumn("n", number).select(
            F.col("l_orderkey").alias("record_id"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"),
            F.col("l_quantity").cast("int").alias("qty"), F.col("n").cast("int").alias("n"),
        )

    def spread(self, docs: DataFrame, scanned: DataFrame | None = None) -> DataFrame:
        """Documents over all cores where the scan has fewer splits than cores (a small test file); else unmoved."""
        cores = self.spark.sparkContext.defaultParallelism
        splits = (docs if scanned is None else scanned).rdd.getNumPartitions()
        return docs.repartition(cores) if splits < cores else docs

    @cached_property
    def own_records(self) -> DataFrame:
        return self.records.filter("family_member_id is null")

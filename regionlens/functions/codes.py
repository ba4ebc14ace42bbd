"""Code tables and the joins that attach their labels."""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

OTHER = "Other"
MISSING = "Missing"

# Two-digit program family, short name, full name.
PROGRAM_FAMILIES = [
    ("01", "Agriculture", "Agriculture, Agriculture Operations, and Related Sciences"),
    ("03", "Nat Resources", "Natural Resources and Conservation"),
    ("04", "Architecture", "Architecture and Related Services"),
    ("05", "Area/Eth/Cult", "Area, Ethnic, Cultural, and Gender Studies"),
    ("09", "Comm & Journ", "Communication, Journalism, and Related Programs"),
    ("10", "Comm Tech", "Communications Technologies/Technicians and Support Services"),
    ("11", "CS/Info Sci", "Computer and Information Sciences and Support Services"),
    ("12", "Culinary & Pers", "Personal and Culinary Services"),
    ("13", "Education", "Education"),
    ("14", "Engr", "Engineering"),
    ("15", "Eng Tech", "Engineering Technologies/Technicians"),
    ("16", "Lang & Ling", "Foreign Languages, Literatures, and Linguistics"),
    ("19", "Family & Cons", "Family and Consumer Sciences/Human Sciences"),
    ("22", "Legal Studies", "Legal Professions and Studies"),
    ("23", "English", "English Language and Literature/Letters"),
    ("24", "Liberal Arts", "Liberal Arts and Sciences, General Studies and Humanities"),
    ("25", "Library Sci", "Library Science"),
    ("26", "Bio & Biomed", "Biological and Biomedical Sciences"),
    ("27", "Math & Stats", "Mathematics and Statistics"),
    ("28", "ROTC/JROTC", "Reserve Officer Training Corps (JROTC, ROTC)"),
    ("29", "Military Tech", "Military Technologies"),
    ("30", "Multidisc", "Multi/Interdisciplinary Studies"),
    ("31", "Parks/Rec/Fit", "Parks, Recreation, Leisure, and Fitness Studies"),
    ("32", "Basic Skills", "Basic Skills"),
    ("33", "Citizenship", "Citizenship Activities"),
    ("34", "Health Skills", "Health-Related Knowledge and Skills"),
    ("35", "Interpersonal", "Interpersonal and Social Skills"),
    ("36", "Leisure & Rec", "Leisure and Recreational Activities"),
    ("37", "Personal Dev", "Personal Awareness and Self-Improvement"),
    ("38", "Phil/Religion", "Philosophy and Religious Studies"),
    ("39", "Theology/Voc", "Theology and Religious Vocations"),
    ("40", "Physical Sci", "Physical Sciences"),
    ("41", "Science Tech", "Science Technologies/Technicians"),
    ("42", "Psychology", "Psychology"),
    ("43", "Security/Prot", "Security and Protective Services"),
    ("44", "Public Admin/SS", "Public Administration and Social Service Professions"),
    ("45", "Social Sci", "Social Sciences"),
    ("46", "Construction", "Construction Trades"),
    ("47", "Mech & Repair", "Mechanic and Repair Technologies/Technicians"),
    ("48", "Precision Prod", "Precision Production"),
    ("49", "Transp/Moving", "Transportation and Materials Moving"),
    ("50", "Visual/Perf Arts", "Visual and Performing Arts"),
    ("51", "Health Prof", "Health Professions and Related Clinical Sciences"),
    ("52", "Biz & Mgmt", "Business, Management, Marketing, and Related Support Services"),
    ("53", "HS Dipl/Cert", "High School/Secondary Diplomas and Certificates"),
    ("54", "History", "History"),
    ("60", "Residency", "Residency Programs"),
]

# Two-digit occupation group, short name, full name.
OCCUPATION_GROUPS = [
    ("11", "Management", "Management Occupations"),
    ("13", "Business & Financial Ops", "Business and Financial Operations Occupations"),
    ("15", "Computer & Math", "Computer and Mathematical Occupations"),
    ("17", "Architecture & Engineering", "Architecture and Engineering Occupations"),
    ("19", "Life/Physical/Social Sci", "Life, Physical, and Social Science Occupations"),
    ("21", "Community & Social Service", "Community and Social Service Occupations"),
    ("23", "Legal", "Legal Occupations"),
    ("25", "Education & Library", "Education, Training, and Library Occupations"),
    ("27", "Arts, Media & Sports", "Arts, Design, Entertainment, Sports, and Media Occupations"),
    ("29", "Healthcare Practitioners & Tech", "Healthcare Practitioners and Technical Occupations"),
    ("31", "Healthcare Support", "Healthcare Support Occupations"),
    ("33", "Protective Service", "Protective Service Occupations"),
    ("35", "Food Prep & Serving", "Food Preparation and Serving Related Occupations"),
    ("37", "Building & Grounds Maint", "Building and Grounds Cleaning and Maintenance Occupations"),
    ("39", "Personal Care & Service", "Personal Care and Service Occupations"),
    ("41", "Sales & Related", "Sales and Related Occupations"),
    ("43", "Office & Admin Support", "Office and Administrative Support Occupations"),
    ("45", "Farming/Fishing/Forestry", "Farming, Fishing, and Forestry Occupations"),
    ("47", "Construction & Extraction", "Construction and Extraction Occupations"),
    ("49", "Install/Maint/Repair", "Installation, Maintenance, and Repair Occupations"),
    ("51", "Production", "Production Occupations"),
    ("53", "Transportation & Material Moving", "Transportation and Material Moving Occupations"),
]

# Award code and label, from the shortest award to the longest.
AWARD_LEVELS = [
    (20, "<12 Week Cert"),
    (21, "12W–1Y Cert"),
    (1, "<1 Year Certificate"),
    (2, "1–2 Year Cert"),
    (3, "Associate"),
    (4, "2–4 Year Cert"),
    (5, "Bachelor's"),
]

# Names and postal codes of the states, the district and the territories.
STATES = [
    ("Alabama", "AL"), ("Alaska", "AK"), ("Arizona", "AZ"), ("Arkansas", "AR"), ("California", "CA"),
    ("Colorado", "CO"), ("Connecticut", "CT"), ("Delaware", "DE"), ("Florida", "FL"), ("Georgia", "GA"),
    ("Hawaii", "HI"), ("Idaho", "ID"), ("Illinois", "IL"), ("Indiana", "IN"), ("Iowa", "IA"),
    ("Kansas", "KS"), ("Kentucky", "KY"), ("Louisiana", "LA"), ("Maine", "ME"), ("Maryland", "MD"),
    ("Massachusetts", "MA"), ("Michigan", "MI"), ("Minnesota", "MN"), ("Mississippi", "MS"), ("Missouri", "MO"),
    ("Montana", "MT"), ("Nebraska", "NE"), ("Nevada", "NV"), ("New Hampshire", "NH"), ("New Jersey", "NJ"),
    ("New Mexico", "NM"), ("New York", "NY"), ("North Carolina", "NC"), ("North Dakota", "ND"), ("Ohio", "OH"),
    ("Oklahoma", "OK"), ("Oregon", "OR"), ("Pennsylvania", "PA"), ("Rhode Island", "RI"), ("South Carolina", "SC"),
    ("South Dakota", "SD"), ("Tennessee", "TN"), ("Texas", "TX"), ("Utah", "UT"), ("Vermont", "VT"),
    ("Virginia", "VA"), ("Washington", "WA"), ("West Virginia", "WV"), ("Wisconsin", "WI"), ("Wyoming", "WY"),
    ("District of Columbia", "DC"), ("Puerto Rico", "PR"), ("Guam", "GU"),
    ("American Samoa", "AS"), ("Northern Mariana Islands", "MP"), ("U.S. Virgin Islands", "VI"),
]


def code_table(spark: SparkSession, rows: Sequence[tuple], schema: pa.Schema) -> DataFrame:
    """A table of constants. Its size is fixed in this file, so it is safe to broadcast."""
    columns = [pa.array(values, field.type) for values, field in zip(zip(*rows), schema)]
    return F.broadcast(spark.createDataFrame(pa.Table.from_arrays(columns, schema=schema)))


_LABELS = pa.schema([("_key", pa.string()), ("_short", pa.string()), ("_full", pa.string())])
_AWARDS = pa.schema([("_key", pa.int32()), ("_label", pa.string()), ("_rank", pa.int32())])
_STATES = pa.schema([("state_name", pa.string()), ("state_abbrev", pa.string())])


def state_table(spark: SparkSession) -> DataFrame:
    return code_table(spark, STATES, _STATES)


def program_family(code: Column) -> Column:
    """First two digits of a program code, padded on the left; null where it has no digit."""
    digits = F.regexp_replace(code.cast("string"), "[^0-9]", "")
    return F.when(F.length(digits) > 0, F.lpad(digits, F.greatest(F.length(digits), F.lit(2)), F.lit("0")).substr(1, 2))


def occupation_group(code: Column) -> Column:
    return code.cast("string").substr(1, 2)


def _attach(df: DataFrame, key: Column, rows: Sequence[tuple], short: str, full: str) -> DataFrame:
    labels = code_table(df.sparkSession, rows, _LABELS)
    joined = df.withColumn("_code_key", key).join(labels, F.col("_code_key") == F.col("_key"), "left")
    return joined.withColumns(
        {short: F.coalesce("_short", F.lit(OTHER)), full: F.coalesce("_full", F.lit(OTHER))}
    ).drop("_code_key", "_key", "_short", "_full")


def classify_program(df: DataFrame, code: str, short: str = "family", full: str = "family_full") -> DataFrame:
    """Short and full family name of a program code, `Other` if there is none."""
    return _attach(df, program_family(F.col(code)), PROGRAM_FAMILIES, short, full)


def classify_occupation(df: DataFrame, code: str, short: str = "group", full: str = "group_full") -> DataFrame:
    """Short and full group name of an occupation code, `Other` if there is none."""
    return _attach(df, occupation_group(F.col(code)), OCCUPATION_GROUPS, short, full)


def classify_award(df: DataFrame, code: str, label: str = "award", rank: str = "award_rank") -> DataFrame:
    """Award label and its place from short to long; unknown codes are `Other`, placed last."""
    rows = [(key, text, position) for position, (key, text) in enumerate(AWARD_LEVELS, start=1)]
    awards = code_table(df.sparkSession, rows, _AWARDS)
    key = F.col(code).cast("string").try_cast("double").try_cast("int")
    joined = df.withColumn("_code_key", key).join(awards, F.col("_code_key") == F.col("_key"), "left")
    return joined.withColumns(
        {label: F.coalesce("_label", F.lit(OTHER)), rank: F.coalesce("_rank", F.lit(len(rows) + 1))}
    ).drop("_code_key", "_key", "_label", "_rank")


def label_codes(
    df: DataFrame, code: str, labels: Sequence[tuple[str, str]], label: str = "label", rank: str = "label_rank", reverse: bool = False
) -> DataFrame:
    """Value labels for a coded column. Ranks follow the given order, or its reverse.

    A null code becomes the explicit level `Missing`, placed last. A code without a label keeps its own text.
    """
    schema = pa.schema([("_key", pa.string()), ("_label", pa.string()), ("_rank", pa.int32())])
    ordered = list(reversed(labels)) if reverse else list(labels)
    rows = [(key, text, position) for position, (key, text) in enumerate(ordered, start=1)]
    table = code_table(df.sparkSession, rows, schema)
    joined = df.withColumn("_code_key", F.col(code).cast("string")).join(table, F.col("_code_key") == F.col("_key"), "left")
    return joined.withColumns(
        {
            label: F.coalesce("_label", "_code_key", F.lit(MISSING)),
            rank: F.coalesce("_rank", F.when(F.col("_code_key").isNull(), len(rows) + 2).otherwise(len(rows) + 1)),
        }
    ).drop("_code_key", "_key", "_label", "_rank")

"""op4: licence phrases and labels of every document."""

from kgspark.llm.common import documents
from kgspark.llm.license_scan import license_rows
from kgspark.llm.registry import query


@query("op4_license_scan")
def op4_license_scan(spark, sf_dir):
    return license_rows(documents(spark, sf_dir))

import os

import pytest

from quillmere.plans import registry
from oracle import same_rows

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, name):
    same_rows(spark, SF, registry.queries()[name], registry.oracle_sql()[name])


def test_every_query_has_sql_or_a_test():
    assert set(registry.queries()) - set(registry.oracle_sql()) == {"heading_sections", "segment_dedup", "alias_annotation", "question_plan_payloads", "window_map_payloads"}

"""Files of graphs are not listed by the driver."""

import __spark_entry__ as entry_points


def test_graph_files_are_listed_by_tasks(spark):
    found = entry_points.queries()["gfa_files"](spark, "/root/testdata/sf0.001")
    assert found.inputFiles() == []
    assert found.filter("line_no = 0 and line like 'H%'").count() == found.select("graph_id").distinct().count() > 0

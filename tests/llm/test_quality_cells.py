"""How cells are dealt: sums within tasks are worth little where a task has a few cells only."""

from palimpsest.llm import quality_rules as Q


def test_few_cells_lie_in_few_partitions(spark):
    cells = spark.range(0, 2 * Q.CELLS_EACH + 1, 1, 40)
    fewer = Q.in_fewer(cells)
    assert fewer.rdd.getNumPartitions() == 3
    assert fewer.count() == cells.count()
    assert Q.in_fewer(spark.range(0)).count() == 0
    assert Q.in_fewer(spark.range(0, 5 * Q.CELLS_EACH, 1, 2)).rdd.getNumPartitions() == 2

"""Operators from DataFrames to DataFrames.

Hits have query_id, id, score, source_op and leg. Scores are rounded to six places where they are ranked,
and ties go to the smaller id, so results do not depend on partitioning.
"""

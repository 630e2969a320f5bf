import os
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SMALL = "/root/testdata/sf0.001"
EDGE = [(5, "", "x", 1), (7, None, None, None), (None, "no id here", "x", 2), (9, "same words here again " * 30, "x", 3),
        (9, "same words here again " * 30, "x", 3), (11, "é ß 漢字 " * 2000, "x", 4), (12, " \t\n", "x", 5)]


def documents(spark, rows=None):
    """Small documents with nulls, ties, repeats and columns whose names clash with results."""
    return spark.createDataFrame(EDGE if rows is None else rows, "doc_id long, text string, score string, fp int")

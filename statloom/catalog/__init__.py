"""Named queries over the test tables, with the SQL they must agree with."""

from statloom.catalog import clustering, gaussian, histogram, lifecycle, matrices, regression, sampling, trees

GROUPS = (regression, sampling, gaussian, histogram, clustering, trees, matrices, lifecycle)
QUERIES = {name: query for group in GROUPS for name, query in group.QUERIES.items()}
ORACLES = {name: sql for group in GROUPS for name, sql in group.ORACLES.items()}

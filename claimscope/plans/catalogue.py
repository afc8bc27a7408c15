"""All core queries by name, with their SQL."""

from __future__ import annotations

from claimscope.plans import analysis, answers, evaluation, exports, files, general, reading, relational, sampling, streams

QUERIES = {**general.QUERIES, **relational.QUERIES, **sampling.QUERIES, **evaluation.QUERIES, **reading.QUERIES, **answers.QUERIES, **analysis.QUERIES, **files.QUERIES, **exports.QUERIES, **streams.QUERIES}
SQL = {**general.SQL, **relational.SQL, **sampling.SQL, **evaluation.SQL, **reading.SQL, **answers.SQL, **analysis.SQL, **files.SQL, **exports.SQL, **streams.SQL}

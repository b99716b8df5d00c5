"""Imports every module that registers queries."""

from tidemark.operators import accounts, aggregates, algebra, bars, custody, decoding, evidence, imports, joins, judgements, kernels, known, learning, machines, market, models, projections, recording, resampling, scans, screens, sets, streams, windows  # noqa: F401
from tidemark.operators import replans  # noqa: F401, E402  after the statements that it gives other plans

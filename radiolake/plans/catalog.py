"""Importing this module registers every query."""

from radiolake.plans import (complaints, diagnosis, headers, health, ingest, network,  # noqa: F401
                             reconcile, rollups, runs, series, spatial, tickets)

"""Set-at-a-time operators: upsert, resolution, audits, hierarchy, catalogue, text jobs."""

"""Case work: alerts, cases, watchlists, dashboards and relationships as queries."""

"""Column functions: tile geometry and the scalar rules of catalogs, links and schedules."""

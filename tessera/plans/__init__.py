"""Plans over the driver's tables: derived graphs, the map/reduce façade, the query catalogue."""

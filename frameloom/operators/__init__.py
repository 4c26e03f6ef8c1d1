"""DataFrame operators: slicing, maps, events, buffers, joins, aggregates, detections."""

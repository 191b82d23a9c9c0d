"""zonewright: territory planning and corpus preparation as Spark plans."""

"""inkgrid: form inspection analytics as Spark DataFrame programs."""

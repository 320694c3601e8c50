"""pressdelta: what changed on published news pages, as Spark jobs over tables and streams."""

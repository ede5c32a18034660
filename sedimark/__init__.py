"""sedimark: dataset engineering and corpus analytics as DataFrame -> DataFrame operators for Spark."""

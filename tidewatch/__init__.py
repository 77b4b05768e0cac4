"""tidewatch: event-report intelligence and corpus preparation on Spark DataFrames."""

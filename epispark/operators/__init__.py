"""DataFrame -> DataFrame indicators. All lazy: nothing here runs a job."""

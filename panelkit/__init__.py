"""panelkit: ranking and forecasting operators for entity-by-period panels, expressed as Spark DataFrame plans."""

"""lapwise: DataFrame-to-DataFrame operators for ordered performance panels."""

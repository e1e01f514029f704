"""Plan layer: plan (de)serialisation, fit/transform cleaner, audited plan
runner, provenance and profile-driven plan suggestion."""

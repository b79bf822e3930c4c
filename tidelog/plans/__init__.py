"""tidelog.plans"""
